"""Global shuffle into shards by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash. Pass two puts each bucket into a fixed order, applies a seeded
Fisher-Yates shuffle to it and writes it; one task takes several buckets in turn.
The buckets one behind the other are one random permutation of all records, and
its places are dealt to the shards in turn, so that counts differ by one at most
(the law `rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import stored

SEED = 7
#: Bytes of text that a bucket holds on average; pass two holds one bucket in memory.
BUCKET_BYTES = 16 << 20
#: Tasks of pass two at most. Where there are more buckets, each task takes several, one after the other.
TASKS = 20_000
#: Rows that share id and text are scattered one by one if there are more than so many of them.
COPIES = 100
RECORD_BYTES = 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, and RECORD_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A random permutation of range(n): order[k] is the record at place k."""
    order = np.arange(n)
    picks = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    held = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        held[i], held[j] = held[j], held[i]
    return np.asarray(held, dtype=np.int64)


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the bytes of docs, one at least."""
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def bucket_of(buckets: int, seed: int, *key: Column | str) -> Column:
    """The bucket of a key, by a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")


def scattered(docs: DataFrame, buckets: int, seed: int = SEED, copies: int = COPIES) -> DataFrame:
    """Pass one: doc_id, text, bucket of each row of docs.

    The bucket comes from id and text, so it does not depend on how the table is
    stored. Rows that share both are the same record; where there are more than
    `copies` of them, each takes the bucket of its number among them, and the
    rows are made anew from one of them and their number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    many = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > copies)
    many = stored(many.select(F.col("doc_id").alias("many_id"), F.col("h").alias("many_h")), "repeated-rows")
    bucket = bucket_of(buckets, seed, "doc_id", "h").alias("bucket")
    if many.isEmpty():
        return rows.select("doc_id", "text", bucket)
    same = rows["doc_id"].eqNullSafe(many["many_id"]) & (rows["h"] == many["many_h"])
    few = rows.join(many, same, "left_anti").select("doc_id", "text", bucket)
    # counted before the shuffle, so each repeated row is sent once by each task
    counted = rows.join(many, same, "left_semi").groupBy("doc_id", "h", "text").agg(F.count(F.lit(1)).alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000)))
    parts = stored(counted, "repeated-texts").withColumn("part", part).repartition("doc_id", "h", "part")
    number = F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.col("n") - 1)))
    each = parts.withColumn("number", number).select("doc_id", "text", bucket_of(buckets, seed, "doc_id", "h", "number").alias("bucket"))
    return few.unionByName(each)


def shuffled(
    docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, tasks: int = TASKS, copies: int = COPIES
) -> DataFrame:
    """Each row of docs (doc_id, text) with its shard, its slot there, and its bucket.

    Slots of a shard run from 0 without gaps. Repeated rows are interchangeable
    and spread like others, see scattered(), so ties leave the result defined;
    the same rows give the same result however they are stored. Null ids are
    scattered by their text. A very long text is in one bucket, which then exceeds
    its bytes by that text. An empty table gives an empty result; further columns
    of docs are not carried.
    """
    buckets = bucket_count(docs, bucket_bytes)
    each = -(-buckets // tasks)
    rows = scattered(docs, buckets, seed, copies).withColumn("task", F.floor(F.col("bucket") / each).cast("int"))
    # one row for each task, at most `tasks`: the first place of each is the count of all before it
    counts = dict(map(tuple, rows.groupBy("task").agg(F.count(F.lit(1))).collect()))
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task] = total
        total += counts[task]

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None

        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            bucket = pa.Table.from_batches(held)
            number = bucket.column("bucket")[0].as_py()
            if place is None:
                place = starts[number // each]
            order = fisher_yates(bucket.num_rows, seed * 1_000_003 + number)
            places = place + np.arange(len(order), dtype=np.int64)
            place += len(order)
            # batches of bounded bytes: taken rows are copied
            for lo in range(0, len(order), 2048):
                part = bucket.take(pa.array(order[lo : lo + 2048])).append_column("place", pa.array(places[lo : lo + 2048]))
                yield from part.to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            b = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column(2)[0].as_py() != b[lo]:
                    yield from close(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close(held)

    # a task's buckets by its number, as a hash of it would put several tasks' into one
    ordered = rows.repartitionById(-(-buckets // each), F.col("task")).drop("task")
    permuted = ordered.sortWithinPartitions("bucket", "doc_id", F.xxhash64("text")).mapInArrow(permute, "doc_id long, text string, bucket int, place long")
    place = F.col("place")
    return permuted.select(
        "doc_id", "text", (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"), "bucket"
    )


def digest(records: DataFrame) -> DataFrame:
    """The records without their texts: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return records.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Writes docs in shuffled order, a folder shard=k for each shard with its rows by slot."""
    (
        shuffled(docs, shards, seed)
        .drop("bucket")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
