"""Periodic runs of words, by a harmonic grid and prefix hashes.

A run of period p and length of at least max(24, 3 p) has a stretch of at least
max(24 - p, 2 p) words that equal those p places on, so a grid of that spacing has
a point in the stretch. For all pairs of a period and a grid point at once, the
longest common extensions of the point and the place p words on are found by
binary search over prefix hashes, to the right and to the left. Their sum says
whether there is a run; of equal runs the one of the smallest period stays, and
its words are verified. Hashes never miss an equal word, so a collision can only
make a run too long; then the words are hashed anew with another base.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST, TIMES = 24, 3
#: Words of several texts that are searched together, and pairs of period and grid point that are looked at together.
CHUNK_WORDS, CHUNK_PAIRS = 1 << 18, 1 << 20
_P = np.uint64((1 << 61) - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo 2^61 - 1, both below it."""
    low, half = np.uint64((1 << 32) - 1), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    mid = _mod(a0 * b1) + _mod(a1 * b0)  # times 2^32
    mid = _mod(mid)
    top = a1 * b1  # times 2^64, which is 8
    shifted = (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half)
    return _mod(_mod(_mod(a0 * b0) + _mod(top * np.uint64(8))) + _mod(shifted))


class PrefixHashes:
    """Polynomial hashes of all stretches of a sequence of numbers."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        values = rng.integers(1, int(_P), int(words.max(initial=0)) + 1).astype(np.uint64)[words]
        base = int(rng.integers(1 << 32, int(_P)))
        powers = np.ones(1, np.uint64)
        while len(powers) <= len(words):
            powers = np.concatenate([powers, _times(powers, np.uint64(pow(base, len(powers), int(_P))))])
        self.powers = powers
        terms = _times(values, powers[: len(words)])
        low = np.cumsum(terms & np.uint64((1 << 32) - 1))
        high = np.cumsum(terms >> np.uint64(32))
        sums = _mod(_mod(low) + _times(_mod(high), np.uint64(1 << 32)))
        self.sums = np.r_[np.zeros(1, np.uint64), sums]

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j on are equal, i < j."""
        one = _mod(self.sums[i + n] + _P - self.sums[i])
        two = _mod(self.sums[j + n] + _P - self.sums[j])
        return _times(one, self.powers[j - i]) == two


def _extension(hashes: PrefixHashes, i: np.ndarray, j: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
    """The most words that are equal right of i and j (from them on) or left of them, by binary search for all pairs at once."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live] + 1) >> 1
        back = middle if left else 0
        same = hashes.equal(i[live] - back, j[live] - back, middle)
        low[live[same]] = middle[same]
        high[live[~same]] = middle[~same] - 1
    return low


def find_runs(words: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """All runs in several texts: rows of text, start (in words, all texts), end, period, by start and period.

    words: numbers of all words, one text behind the other; ends: where each ends.
    """
    begins = np.r_[0, ends[:-1]]
    hashes = PrefixHashes(words, seed)
    most = np.maximum((ends - begins) // TIMES * (ends - begins >= SHORTEST), 0)
    text = np.repeat(np.arange(len(ends)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    spacing = np.maximum(SHORTEST - period, (TIMES - 1) * period)
    points = -(-((ends - begins)[text] - period) // spacing)
    edges = np.cumsum(points)
    found = []
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(edges, (edges[lo - 1] if lo else 0) + CHUNK_PAIRS, "right")))
        own = np.repeat(np.arange(lo, hi), points[lo:hi])
        place = np.arange(len(own)) - np.repeat(np.cumsum(points[lo:hi]) - points[lo:hi], points[lo:hi])
        i = begins[text[own]] + place * spacing[own]
        p = period[own]
        same = words[i] == words[i + p]
        own, i, p = own[same], i[same], p[same]
        right = _extension(hashes, i, i + p, ends[text[own]] - i - p, False)
        left = _extension(hashes, i, i + p, i - begins[text[own]], True)
        long = right + left >= spacing[own]
        runs = np.stack([text[own], i - left, i + p + right, p], axis=1)[long]
        found.append(np.unique(runs, axis=0) if len(runs) else runs)
        lo = hi
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    new = np.r_[True, (runs[1:, 1] != runs[:-1, 1]) | (runs[1:, 2] != runs[:-1, 2])] if len(runs) else np.zeros(0, bool)
    kept = runs[new]
    smallest = kept[np.cumsum(new) - 1, 3] if len(runs) else runs[:, 3]
    # equal runs have multiples of the smallest period; anything else, or words that differ, is a collision
    sound = not (runs[:, 3] % np.maximum(smallest, 1)).any() and all((words[s : e - q] == words[s + q : e]).all() for _, s, e, q in kept.tolist())
    if not sound:
        return find_runs(words, ends, seed + 1)
    return kept[np.lexsort((kept[:, 3], kept[:, 1]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, and where each text ends."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((number[w] for t in texts for w in t), np.int64)
    return words, np.cumsum([len(t) for t in texts], dtype=np.int64)


def repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the checksum of its id, with its words from one place on repeated in periods."""
    import zlib

    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _of_text(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """What is said of one text: runs are (start, end, period) by start and period."""
    best, kept = None, words
    for start, end, period in runs:
        length = end - start
        if best is None or length * best[2] > best[1] * period:  # ties stay with the first
            best = (start, length, period)
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, end, period in runs:
            drop[start + period] += 1
            drop[end] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    return {
        "runs": [{"start": s, "length": e - s, "period": q} for s, e, q in runs],
        "best": dict(zip(("start", "length", "period"), best)) if best else None,
        "collapsed": b" ".join(kept),
    }


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.binary())])
_SCHEMA = "doc_id long, runs array<{0}>, best {0}, collapsed binary".format("struct<start:bigint,length:bigint,period:bigint>")


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period, by start and period), best, collapsed.

    Words are parted by ASCII white space. A run is a longest stretch of words in
    which those `period` places apart are equal, for the smallest such period, of
    at least max(24, 3 period) words. best is the run of the greatest length by
    period, of ties the first, null where there is no run. collapsed holds the
    words that no run has after its first period, joined by spaces, as UTF-8.
    planted repeats words of every tenth document first, see repeating(); a null
    doc_id is not among them. Null and empty texts have no words; repeated rows
    each get a row; further columns are ignored; a table without rows gives none.
    Texts are searched some 262,144 words at a time, and a longer text alone.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
            words, ends = numbered(texts)
            of: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            begins = np.r_[0, ends[:-1]].tolist()
            for text, start, end, period in find_runs(words, ends).tolist():
                of[text].append((start - begins[text], end - begins[text], period))
            rows = [{"doc_id": d, **_of_text(t, of.get(k, []))} for k, (d, t) in enumerate(zip(ids, texts))]
            return pa.RecordBatch.from_pylist(rows, _ARROW)

        for batch in batches:
            ids, texts, n = [], [], 0
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                words = repeating(words, d) if planted else words
                if texts and n + len(words) > CHUNK_WORDS:
                    yield solved(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(d)
                texts.append(words)
                n += len(words)
            if texts:
                yield solved(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, _SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The columns of op11."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[k].alias(k) for k in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
