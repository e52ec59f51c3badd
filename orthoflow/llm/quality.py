"""Quality by a factorisation machine.

Features are hashed words, binned structure statistics and binned metadata. Each
has a weight and a short vector; the score adds all pairwise products of
vectors, by the identity sum_{i<j} <v_i, v_j> x_i x_j = ((sum v x)^2 - sum (v x)^2) / 2
in time linear in the features of a text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.langid import _rows_of, held_out
from orthoflow.llm.scratch import labelled_sample

#: So many labelled rows are read to learn at most.
MAX_TRAIN_ROWS = 10_000
#: Buckets of words, bins of each statistic, buckets of metadata, and the length of the vectors.
WORDS, BINS, META, RANK = 1 << 15, 16, 1 << 10, 8
STATISTICS = (
    "characters", "words", "word_length", "capitals", "digits", "marks", "bars", "lines",
    "different_words", "commonest_word", "word_again", "different_lines", "spaces", "beyond_ascii",
)
SIZE = WORDS + BINS * len(STATISTICS) + META


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # SIZE
    vectors: np.ndarray  # SIZE x RANK


def _share(x: float, n: float) -> int:
    """Bin of a share, on a square-root scale."""
    return min(BINS - 1, int(math.sqrt(x / n if n else 0.0) * BINS))


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each of STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(words)
    letters = int(of[65:91].sum() + of[97:123].sum() + of[128:].sum())
    digits, spaces = int(of[48:58].sum()), int(of[32] + of[9:14].sum())
    lines = text.split("\n")
    return [
        min(BINS - 1, n.bit_length()),
        min(BINS - 1, k.bit_length()),
        min(BINS - 1, int(len(text) / k)) if k else 0,
        _share(int(of[65:91].sum()), n),
        _share(digits, n),
        _share(n - letters - digits - spaces, n),
        _share(int(of[124]), k),
        _share(len(lines) - 1, k),
        min(BINS - 1, int(len(counts) / k * BINS)) if k else 0,
        _share(max(counts.values(), default=0), k),
        _share(sum(map(eq, words, words[1:])), k),
        min(BINS - 1, int(len(set(lines)) / len(lines) * BINS)),
        _share(spaces, n),
        _share(int(of[128:].sum()), n),
    ]


def features(text: str | None, meta: Sequence = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; words share one unit of length, statistics and metadata another."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    bins = statistics(text, words, counts)
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(value):
        value /= math.sqrt(float(value @ value))
    rest = [WORDS + j * BINS + b for j, b in enumerate(bins)]
    for j, x in enumerate(meta):
        name = "null" if x is None else str(int(math.log2(abs(x) + 1))) if isinstance(x, int | float) else str(x)
        rest.append(SIZE - META + zlib.crc32(f"{j}={name}".encode()) % META)
    ones = np.full(len(rest), 1 / math.sqrt(len(rest)), np.float32)
    return np.concatenate([hashed, np.asarray(rest, np.int64)]), np.concatenate([value, ones])


def raw_score(m: Machine, at: np.ndarray, x: np.ndarray) -> float:
    vx = m.vectors[at] * x[:, None]
    s = vx.sum(axis=0)
    return m.bias + float(m.weights[at] @ x) + 0.5 * float(s @ s - (vx * vx).sum())


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], epochs: int = 14, seed: int = 3) -> Machine:
    """A machine from feature rows and labels, by Adagrad on the logistic loss over small batches."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(math.log(mean / (1 - mean))), np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    gw, gv, gb = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs if len(set(labels)) > 1 else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            at = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            sizes = [len(rows[i][0]) for i in pick]
            doc, begin = np.repeat(np.arange(len(pick)), sizes), np.cumsum([0, *sizes[:-1]])
            v = m.vectors[at]
            vx = v * x[:, None]
            s = np.add.reduceat(vx, begin)
            z = m.bias + np.add.reduceat(m.weights[at] * x, begin) + 0.5 * (s * s - np.add.reduceat(vx * vx, begin)).sum(axis=1)
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            each = error[doc] * x
            seen, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, each, len(seen)).astype(np.float32) + 1e-5 * m.weights[seen]
            gw[seen] += g * g
            m.weights[seen] -= 0.1 * g / np.sqrt(gw[seen])
            slope = each[:, None] * (s[doc] - vx)
            g = np.stack([np.bincount(where, slope[:, f], len(seen)) for f in range(RANK)], axis=1).astype(np.float32)
            g += 1e-4 * m.vectors[seen]
            gv[seen] += g * g
            m.vectors[seen] -= 0.05 * g / np.sqrt(gv[seen])
            total = float(error.sum())
            gb += total * total
            m.bias -= 0.1 * total / math.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", meta: Sequence[str] = (), max_train_rows: int = MAX_TRAIN_ROWS) -> Machine | None:
    """Learns from the labelled rows that are not held out; None if there are none.

    Reads all of them if they are at most max_train_rows, else about so many,
    chosen by hashes; rows that repeat id, text and metadata count once. Features are made of whole texts where the rows are, and one task
    with a bounded number of rows learns.
    """
    own = labels.where(~held_out(5, 0) & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    own = own.select("doc_id", F.col(target).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.where(~held_out(5, 0) & F.col("doc_id").isNotNull())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta)
    sample = labelled_sample(docs, own, max_train_rows)
    schema = "doc_id long, label int, at array<int>, x array<float>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, label, *features(t, m)) for i, t, *m, label in _rows_of(batch)]
            if rows:
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
                columns += [pa.array([r[2].astype(np.int32) for r in rows]), pa.array([r[3] for r in rows])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "at", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                rows.append((ids[k], given[k], batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()))
        rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
        if rows:
            m = learn([(r[2].astype(np.int64), r[3]) for r in rows], [r[1] for r in rows])
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (m.weights, m.vectors)]
            yield pa.RecordBatch.from_arrays([pa.array([m.bias]), *blobs], ["bias", "weights", "vectors"])

    found = sample.mapInArrow(make, schema).repartition(1).mapInArrow(train, "bias double, weights binary, vectors binary").collect()
    if not found:
        return None
    bias, weights, vectors = found[0]
    return Machine(bias, np.frombuffer(weights, np.float32), np.frombuffer(vectors, np.float32).reshape(SIZE, RANK))


def quality(docs: DataFrame, m: Machine | None, meta: Sequence[str] = (), threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Null texts are empty texts; null metadata is a value of its own. Without a
    machine every score is 0.5. Repeated rows each get a row, and columns other
    than doc_id, text and meta are not read. Texts are read whole, and an empty
    table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if m is not None:
                z = np.fromiter((raw_score(m, *features(t, more)) for _, t, *more in _rows_of(batch)), float, batch.num_rows)
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta)
    return rows.mapInArrow(scored, "doc_id long, score double, predicted int")
