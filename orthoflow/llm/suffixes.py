"""Removal of repeated strings with a distributed, sparse suffix array.

A start x is repeated if the `span` bytes from x on also start anywhere else. A
suffix for each byte would be `span` times the corpus, so suffixes start at
anchors: the anchor of x is the leftmost of the least 8-byte words that start in
the `window` bytes from x on. Equal strings have equal anchors, so what anchors
share decides about all starts, and nothing is missed.

Anchors of which no other shares the first `span - window + 1` bytes (the lead)
are done, as are those whose text is the same for all starts of a lead. For the
rest, one record of each text goes on: sampled splitters range-partition the
suffixes by their leading tokens of 8 bytes; each bucket sorts them by multikey
quicksort, a token at a time, and what stands left of the anchors in the same
way. Two starts d bytes left of their anchors are equal if neighbours in the
first order share span - d bytes and neighbours in the second one d bytes. Each
bucket compares its suffixes with those at its boundaries: a lead that goes on
beyond a splitter (so any lead with more suffixes than a bucket) is decided by
counting the strings of all its starts instead, which pre-aggregates.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import Tables, attach, hashed_below, stored, train_fraction

SPAN = 400
WINDOW = 256
TOKEN = 8
#: Bytes of records that a bucket holds; at most RANGES ranges, which are divided by the hash of the lead where that is not enough.
BUCKET_BYTES, RANGES = 8 << 20, 20_000
#: Sampled suffixes for each range.
SAMPLED = 16
#: Up to so many ids of texts are broadcast, more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Starts that are looked at together in one text.
SEGMENT = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
#: The least numbers of two, three ... eight bytes.
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def anchors(text: bytes, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, with the first and the last start of each; every start that has span bytes belongs to one."""
    starts = len(text) - span + 1
    found = []
    for begin in range(0, starts, SEGMENT):
        n = min(SEGMENT, starts - begin)
        own = np.frombuffer(text, np.uint8, n + window - 1 + TOKEN - 1, begin)
        code = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, TOKEN)).view("<u8").ravel()
        code = code * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        # the place in the low bits makes the leftmost of equal codes the least
        code = (code & ~_PLACE) | np.arange(len(code), dtype=np.uint64)
        full = np.full(-(-len(code) // window) * window, np.iinfo(np.uint64).max, np.uint64)
        full[: len(code)] = code
        rows = full.reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((begin + place[first], begin + first, begin + np.r_[first[1:], n] - 1))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def text_anchors(docs: DataFrame, span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """A row for each anchor of each text: doc_id, h, at, first, last, lead, whole (hashes of the lead, of all that its starts cover)."""
    import xxhash

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, lead = xxhash.xxh3_64_intdigest, span - window + 1
        for batch in batches:
            texts, held, n = batch.column(2).cast(pa.binary()), [], 0
            for k in range(len(texts)):
                text = texts[k].as_py() or b""
                if len(text) >= span:
                    at, first, last = anchors(text, span, window)
                    leads = [digest(text[a : a + lead]) for a in at.tolist()]
                    wholes = [digest(text[a : b + span], 1) for a, b in zip(first.tolist(), last.tolist())]
                    held.append((np.full(len(at), k), at, first, last, np.array(leads, np.uint64), np.array(wholes, np.uint64)))
                    n += len(at)
                if held and (k == len(texts) - 1 or n > 100_000):
                    row, at, first, last, leads, wholes = (np.concatenate(x) for x in zip(*held))
                    held, n = [], 0
                    ids = [batch.column(j).take(pa.array(row)) for j in (0, 1)]
                    places = [pa.array(x.astype(np.int64)) for x in (at, first, last)]
                    yield pa.RecordBatch.from_arrays([*ids, *places, pa.array(leads.view(np.int64)), pa.array(wholes.view(np.int64))], _ANCHOR_NAMES)

    return docs.mapInArrow(cut, _ANCHOR)


_ANCHOR_NAMES = ["doc_id", "h", "at", "first", "last", "lead", "whole"]
_ANCHOR = ", ".join(f"{name} long" for name in _ANCHOR_NAMES)


def multikey_order(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (padded with zero bytes to `width`) and the bytes that each shares with the one before it in that order.

    Multikey quicksort on tokens of 8 bytes: strings that tie on a token are
    divided by the next one, all groups of ties at once.
    """
    n = len(strings)
    tokens = -(-width // TOKEN)
    table = np.frombuffer(b"".join(s[:width].ljust(tokens * TOKEN, b"\0") for s in strings), ">u8").reshape(n, tokens)
    order, shared = np.arange(n), np.full(n, tokens * TOKEN)
    shared[:1] = 0
    group = np.zeros(n, np.int64)  # of each place
    tied = np.arange(n) if n > 1 else np.arange(0)  # places that still stand in a group of more than one
    for depth in range(tokens):
        if not len(tied):
            break
        token = table[order[tied], depth].astype(np.uint64)
        by = np.lexsort((token, group[tied]))
        order[tied], token = order[tied][by], token[by]
        same_group = np.r_[False, group[tied][1:] == group[tied][:-1]]
        differ = np.r_[token[:1], token[1:] ^ token[:-1]]
        split = same_group & (differ != 0)
        shared[tied[split]] = depth * TOKEN + TOKEN - 1 - np.searchsorted(_BYTES, differ[split], "right")
        begins = split | ~same_group
        label = np.cumsum(begins)
        group[tied] = tied[begins][label - 1]
        tied = tied[np.bincount(label)[label] > 1]
    return order, np.minimum(shared, width)


def repeated_starts(texts: list[bytes], at: np.ndarray, span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts of texts that another of them repeats at the same distance from its anchor: text and start, by both.

    texts are different; text k has its anchor at at[k], and its starts are 0 to len - span.
    """
    n = len(texts)
    far, near = at, at - np.array([len(t) - span for t in texts], np.int64)
    right, right_shared = multikey_order([t[a:] for t, a in zip(texts, at.tolist())], span)
    left, left_shared = multikey_order([t[:a][::-1] for t, a in zip(texts, at.tolist())], window)
    run, side, found = np.empty(n, np.int64), np.empty(n, np.int64), []
    for d in range(window):
        live = np.flatnonzero((near <= d) & (d <= far))
        if len(live) < 2:
            continue
        run[right] = np.cumsum(right_shared < span - d)
        side[left] = np.cumsum(left_shared < d)
        key = run[live] * (n + 1) + side[live]
        by = np.argsort(key, kind="stable")
        same = np.r_[False, key[by][1:] == key[by][:-1]]
        again = live[by[same | np.r_[same[1:], False]]]
        found.append(np.stack([again, far[again] - d]))
    which, start = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    by = np.lexsort((start, which))
    return which[by], start[by]


def runs(which: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts one behind the other: which, first, last."""
    begins = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)]) if len(which) else np.zeros(0, int)
    ends = np.r_[begins[1:], len(which)] - 1 if len(begins) else begins
    return which[begins], start[begins], start[ends]


def _records(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The records of wanted: lead, whole, at (in body), body: the bytes that the starts of an anchor cover."""
    anchor = F.struct("at", "first", "last", "lead", "whole")
    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(anchor).alias("records")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "records")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0).cast(pa.binary()), batch.column(1)
            for k in range(len(texts)):
                text, rows = texts[k].as_py(), lists[k].as_py()
                for few in (rows[i : i + 4096] for i in range(0, len(rows), 4096)):
                    yield pa.RecordBatch.from_pydict({
                        "lead": [r["lead"] for r in few], "whole": [r["whole"] for r in few], "at": [r["at"] - r["first"] for r in few],
                        "body": [text[r["first"] : r["last"] + span] for r in few],
                    })

    few = wanted.select(F.col("h").alias("_h")).distinct()
    if wanted.count() <= BROADCAST_ROWS:  # most texts need not move
        docs = docs.join(F.broadcast(few), docs["h"] == few["_h"], "left_semi")
    both = docs.join(lists, docs["doc_id"].eqNullSafe(lists["_id"]) & (docs["h"] == lists["_h"]))
    return both.select("text", "records").mapInArrow(cut, "lead long, whole long, at long, body binary")


def sampled_splitters(docs: DataFrame, wanted: DataFrame, ranges: int, span: int) -> list[bytes]:
    """ranges - 1 splitters from a bounded sample of the suffixes, each the shortest string that parts two sampled ones."""
    if ranges < 2:
        return []
    share = train_fraction(wanted.count(), ranges * SAMPLED)
    sample = sorted(r["body"][r["at"] :] for r in _records(docs, wanted.where(hashed_below(share, "lead", "whole")), span).collect())
    splitters = []
    for k in sorted({i * len(sample) // ranges for i in range(1, ranges)} - {0}):
        below, above = sample[k - 1], sample[k]
        shared = next((i for i, (x, y) in enumerate(zip(below, above)) if x != y), min(len(below), len(above)))
        splitters.append(bytes(above[: shared + 1]))
    return sorted(set(splitters))


def _partitioned(records: DataFrame, splitters: list[bytes], parts: int, span: int, window: int) -> DataFrame:
    """Records with their bucket; those of a lead that goes on beyond a splitter are crossing, and bucket is null."""
    lead = span - window + 1
    crossing = {s[:lead] for s in splitters if len(s) > lead}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, body, leads = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist()
            bucket = [
                None if b[a : a + lead] in crossing else bisect_right(splitters, b[a:]) * parts + h % parts
                for a, b, h in zip(at, body, leads)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], ["bucket", "lead", "whole", "at", "body"])

    return records.mapInArrow(place, "bucket int, lead long, whole long, at long, body binary")


_FOUND = "lead long, whole long, first long, last long"


def _sorted_buckets(placed: DataFrame, span: int, window: int, buckets: int) -> DataFrame:
    """Repeated starts of the records of each bucket, as runs from the first start of each record on."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            at = table.column("at").to_numpy()
            which, first, last = runs(*repeated_starts(table.column("body").to_pylist(), at, span, window))
            names = [table.column(k).take(pa.array(which)).combine_chunks() for k in ("lead", "whole")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(first), pa.array(last)], ["lead", "whole", "first", "last"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != b[lo]:
                    yield from close(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close(held)

    return placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(solve, _FOUND)


def _counted_starts(crossing: DataFrame, span: int) -> DataFrame:
    """Repeated starts of crossing records, by counting the strings of all their starts."""
    import xxhash

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, whole, body in zip(*(batch.column(k).to_pylist() for k in ("lead", "whole", "body"))):
                codes = [xxhash.xxh3_128_digest(body[x : x + span]) for x in range(len(body) - span + 1)]
                n = len(codes)
                yield pa.RecordBatch.from_pydict({"lead": [lead] * n, "whole": [whole] * n, "first": list(range(n)), "code": codes})

    rows = stored(crossing.mapInArrow(strings, "lead long, whole long, first long, code binary"), "crossing-starts")
    twice = stored(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crossing-strings")
    return attach(rows, twice, "code", "n").select("lead", "whole", "first", F.col("first").alias("last"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and text of each row; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def repeated_spans(docs: DataFrame, span: int = SPAN, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Runs of repeated starts of each text of keyed(): doc_id, h, first, last; a start may be in two runs."""
    early = Tables(docs.sparkSession)
    found = early.stored(text_anchors(docs, span, window), "anchors")
    of_lead = found.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    shared = early.stored(of_lead.where("n > 1").select("lead", "n", (F.col("a") != F.col("b")).alias("mixed")), "shared-leads")
    candidates = stored(attach(found, shared, "lead", "n").drop("n"), "candidates")
    early.release()
    same = candidates.where("NOT mixed").select("doc_id", "h", "first", "last")
    mixed = candidates.where("mixed")
    one = F.min(F.struct("doc_id", "h", "at", "first", "last")).alias("one")
    texts = stored(mixed.groupBy("lead", "whole").agg(F.count(F.lit(1)).alias("n"), one).select("lead", "whole", "n", "one.*"), "different-texts")
    size = texts.agg(F.sum(F.col("last") - F.col("first") + span)).first()[0]
    if not size:
        return same
    pieces = -(-size // bucket_bytes)
    ranges = min(pieces, RANGES)
    parts = -(-pieces // ranges)
    splitters = sampled_splitters(docs, texts, ranges, span)
    placed = _partitioned(_records(docs, texts, span), splitters, parts, span, window)
    if any(len(s) > span - window + 1 for s in splitters):
        placed = stored(placed, "records")
    starts = _sorted_buckets(placed.where("bucket IS NOT NULL"), span, window, (len(splitters) + 1) * parts)
    if any(len(s) > span - window + 1 for s in splitters):
        starts = starts.unionByName(_counted_starts(placed.where("bucket IS NULL"), span))
    lists = starts.groupBy("lead", "whole").agg(F.collect_list(F.struct(F.col("first").alias("i"), F.col("last").alias("j"))).alias("own"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("i"), (F.col("last") - F.col("first")).alias("j")))
    key = F.struct("lead", "whole").alias("key")
    own = texts.join(lists, ["lead", "whole"], "left").select(key, "n", F.when(F.col("n") > 1, every).otherwise(F.col("own")).alias("own"))
    decided = stored(own.where("own IS NOT NULL"), "decided")
    rest = attach(mixed.select("doc_id", "h", "first", key), decided, "key", "n").select("doc_id", "h", "first", F.explode("own").alias("own"))
    return same.unionByName(rest.select("doc_id", "h", (F.col("first") + F.col("own.i")).alias("first"), (F.col("first") + F.col("own.j")).alias("last")))


def kept_texts(docs: DataFrame, span: int = SPAN, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs of bytes, array of from and until), kept (binary).

    A byte goes if a string of `span` bytes that covers it also starts anywhere
    else, in the same text or another one. Null texts are empty; texts of fewer
    bytes stay whole. Repeated rows each get a row and repeat each other. A very
    long text is read whole in one task; its starts are looked at by segments.
    An empty table gives an empty result; further columns are ignored.
    """
    rows = keyed(docs)
    found = repeated_spans(rows, span, window, bucket_bytes)
    lists = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    lists = stored(lists.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "runs"), "runs-by-text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, own, out, spans, last = batch.column(1).cast(pa.binary())[k].as_py(), batch.column(2)[k].as_py(), [], [], 0
                for first, until in sorted((r["first"], r["last"] + span) for r in own):
                    if spans and first <= spans[-1]["until"]:
                        spans[-1]["until"] = max(until, spans[-1]["until"])
                    else:
                        spans.append({"from": first, "until": until})
                for s in spans:
                    out.append(text[last : s["from"]])
                    last = s["until"]
                out.append(text[last:])
                columns = {"doc_id": [batch.column(0)[k].as_py()], "n_bytes": [len(text)], "spans": [spans], "kept": [b"".join(out)]}
                yield pa.RecordBatch.from_pydict(columns, _KEPT_ARROW)

    same = rows["doc_id"].eqNullSafe(lists["_id"]) & (rows["h"] == lists["_h"])
    few = lists.select("_id", "_h")
    if lists.count() <= BROADCAST_ROWS:
        on = rows["doc_id"].eqNullSafe(few["_id"]) & (rows["h"] == few["_h"])
        whole, rows = rows.join(F.broadcast(few), on, "left_anti"), rows.join(F.broadcast(few), on, "left_semi")
    else:
        whole = rows.join(few, same, "left_anti")
    none = F.array().cast(_SPANS)
    whole = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    part = rows.join(lists, same).select("doc_id", "text", "runs").mapInArrow(cut, f"doc_id long, n_bytes long, spans {_SPANS}, kept binary")
    return whole.unionByName(part)


_SPANS = "array<struct<from:bigint,until:bigint>>"
_KEPT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))), ("kept", pa.binary()),
])


def report(kept: DataFrame) -> DataFrame:
    """The columns of op12."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["until"] - s["from"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
