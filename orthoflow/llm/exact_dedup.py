"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Copies are merged three times, and each time rows are one group only if digest
and full content are equal: within each task (the map side of the first
aggregate), within each salt, and over the winners of all salts. A hot text thus
reaches its last task as at most one row for each salt. Rows find their group by
its digest where that stands for one content, and by the content itself where
several contents share a digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import attach, least_of_ties, stored

WHITESPACE = r"[\x20\x09-\x0D]+"
#: Numbers of equal rows that a task makes from one row at most.
CHUNK = 100_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_groups(docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each digest of a normalised text: text_sha256, keep_id, group_size, contents.

    The smallest doc_id wins; null ids lose to all others. contents is the number
    of texts with that digest; where it is not 1, keep_id and group_size are of
    all of them together.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("content")).select(
        "doc_id",
        "content",
        digest(F.col("content")).alias("text_sha256"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    by_salt = rows.groupBy("salt", "text_sha256", "content").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    winners = by_salt.groupBy("text_sha256", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    return winners.groupBy("text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """Each row of rows (columns key) with its number among its equals, copy, from 1.

    Equal rows are counted, in each task first, and made anew from their count:
    no task holds a group. Beyond CHUNK of them the numbers are made in several tasks.
    """
    counted = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "counted-rows")
    few = counted.where(F.col("n") <= CHUNK).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    many = counted.where(F.col("n") > CHUNK)
    if many.isEmpty():
        return few
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    parts = many.withColumn("part", part).repartition(*key, "part")
    copies = F.sequence(F.col("part") * CHUNK + 1, F.least((F.col("part") + 1) * CHUNK, F.col("n")))
    return few.unionByName(parts.select(*key, F.explode(copies).alias("copy")))


def exact_duplicates(docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copy.

    Null texts are empty texts, and very long ones are compared whole. Of rows
    that share id and text one is kept; copy numbers them from 1. A group in which
    every id is null has a null keep_id and one kept row. Contents that share a
    digest stay apart. An empty table gives an empty result; further columns of
    docs are ignored.
    """
    groups = stored(content_groups(docs, salts, digest), "content-groups")
    content = normalised(F.col("text"))
    rows = numbered(docs.select("doc_id", digest(content).alias("text_sha256")), "doc_id", "text_sha256")
    joined = attach(rows, groups, "text_sha256", "group_size")
    shared = groups.where("contents > 1").select("text_sha256")
    if not shared.isEmpty():
        own = docs.select("doc_id", digest(content).alias("text_sha256"), content.alias("apart")).join(shared, "text_sha256")
        own = stored(own, "shared-digests")
        by_content = own.groupBy("text_sha256", "apart").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        own = numbered(own, "doc_id", "text_sha256", "apart").join(by_content, ["text_sha256", "apart"]).drop("apart")
        joined = joined.where("contents = 1").drop("contents").unionByName(own)
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "copy",
    )


def drop_duplicates(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, with all their columns.

    Of rows that share id and text but for white space, the least by text, then by
    its other columns, stays, however the table is stored. Null texts are empty,
    and very long ones are compared whole; an empty table gives an empty result.
    """
    found = stored(exact_duplicates(docs, salts), "exact-duplicates")
    kept = found.where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha256"))
    digest = F.sha2(normalised(docs["text"]), 256)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep_id"]) & (digest == kept["_keep_sha256"]), "left_semi")
    ties = found.where("copy = 2").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    return out if ties.isEmpty() else least_of_ties(out, ties, F.sha2(normalised(out["text"]), 256))
