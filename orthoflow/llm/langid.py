"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds those of
its letters, permuted by their places (the product of the vector rolled twice,
once and not at all). A document bundles the vectors of its trigrams, a language
the documents of its training sample, and the cosine of the two decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import hashed_below, train_fraction

DIMENSION = 1024
#: a-z have a symbol each, other letters share the rest by a hash; 0 is whatever is no letter.
SYMBOLS = 64
SEED = 20_011
#: So many documents are read to learn at most.
MAX_TRAIN_ROWS = 20_000
UNKNOWN = "und"
#: The standard deviation of the cosine of two random vectors. A text whose cosines with all prototypes are below it has no
#: language that was learned; short texts of a learned one have little more, so a higher limit would reject them.
LEAST = DIMENSION**-0.5


class Profiles:
    """Bundles texts. Trigram vectors are made when first met; there are at most SYMBOLS**3."""

    def __init__(self, dimension: int = DIMENSION, seed: int = SEED) -> None:
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimension))
        self.symbol = np.full(0x110000, -1, np.int16)
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((4096, dimension), np.float32)
        self.known = 0

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.symbol[points]
        if (found < 0).any():
            for p in set(points[found < 0].tolist()):
                c = chr(p)
                if not c.isalpha():
                    s = 0
                elif "a" <= c <= "z":
                    s = 1 + ord(c) - ord("a")
                else:
                    s = 27 + (p * 2_654_435_761 >> 7) % (SYMBOLS - 27)
                self.symbol[p] = s
            found = self.symbol[points]
        return found

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if (rows < 0).any():
            for code in codes[rows < 0].tolist():
                a, b, c = code // SYMBOLS**2, code // SYMBOLS % SYMBOLS, code % SYMBOLS
                if self.known == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[self.known] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
                self.row[code] = self.known
                self.known += 1
            rows = self.row[codes]
        return rows

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector, of length 1; None without a letter."""
        s = self._symbols(f" {(text or '').lower()} ").astype(np.int32)
        middle = np.flatnonzero(s[1:-1])
        if not len(middle):
            return None
        codes = (s[middle] * SYMBOLS + s[middle + 1]) * SYMBOLS + s[middle + 2]
        if len(codes) > 2000:
            counts = np.bincount(codes)
            codes = np.flatnonzero(counts)
            counts = counts[codes]
        else:
            codes, counts = np.unique(codes, return_counts=True)
        rows = self._rows(codes)
        v = counts.astype(np.float32) @ self.vectors[rows]
        size = float(np.sqrt(v @ v))
        return v / size if size else v


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for lo in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns))


def fit(labelled: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Language prototypes from labelled rows (doc_id, text, lang).

    Reads all rows if there are at most max_train_rows, else about so many,
    chosen by a hash of doc_id and text. Sums are made by task, then in a few tasks.
    """
    labelled = labelled.where("lang is not null")
    share = train_fraction(labelled.count(), max_train_rows)
    schema = "lang string, v array<float>"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimension), {}
        for batch in batches:
            for text, lang in _rows_of(batch):
                v = profiles.bundle(text)
                if v is not None:
                    sums[lang] = sums[lang] + v if lang in sums else v
        yield _sums(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, v in _rows_of(batch):
                v = np.asarray(v, np.float32)
                sums[lang] = sums[lang] + v if lang in sums else v
        yield _sums(sums)

    def _sums(sums: dict) -> pa.RecordBatch:
        vectors = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), vectors], ["lang", "v"])

    sample = labelled.where(hashed_below(share, "doc_id", "text"))
    sums = sample.select("text", "lang").mapInArrow(learn, schema).repartition(4, "lang").mapInArrow(add, schema)
    total: dict[str, np.ndarray] = {}
    for lang, v in sorted(sums.collect()):  # a row for each language
        total[lang] = total.get(lang, 0) + np.asarray(v, np.float64)
    return {lang: (v / np.linalg.norm(v)).astype(np.float32) for lang, v in total.items() if np.linalg.norm(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimension: int = DIMENSION) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    score is the cosine with the nearest prototype, cut to 0..1. Null texts,
    texts without a letter, and all texts if nothing was learned, are `und` with
    score 0. Ties go to the first language in sort order. Only doc_id and text
    are read, texts as a whole. Repeated rows each get a row, and an empty table
    gives an empty result.
    """
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else np.zeros((0, dimension), np.float32)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimension)
        for batch in batches:
            found, scores = [], []
            for (text,) in _rows_of(batch.select([1])):
                v = profiles.bundle(text) if langs else None
                cosines = matrix @ v if v is not None else None
                found.append(UNKNOWN if v is None else langs[int(cosines.argmax())])
                scores.append(0.0 if v is None else float(min(1, max(0, cosines.max()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(named, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int):
    """Whether a document is kept from training, by crc32 of doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs that are not held out, predicts all of them.

    Returns doc_id, held_out, lang_pred, score; a null doc_id is not held out.
    """
    labelled = docs.where(~held_out(4, 2)).select("doc_id", "text", "lang")
    return predict(docs, fit(labelled)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language; it fills `lang` where that is null.

    A document goes if it would be `und` (null, or without a letter), or if its
    cosine with every prototype is below `least`, so that its nearest language
    says nothing. Given languages stay. With nothing learned every text with a
    letter stays as it is. Repeated rows stay or go together; an empty table gives
    an empty result. Rows are filtered where they are; nothing is shuffled.
    """
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]) if langs else None
    at, named = docs.columns.index("text"), docs.columns.index("lang")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(len(matrix[0]) if matrix is not None else DIMENSION)
        for batch in batches:
            mask, found = [], []
            for text, lang in _rows_of(batch.select([at, named])):
                v = profiles.bundle(text)
                cosines = None if v is None or matrix is None else matrix @ v
                mask.append(v is not None and (cosines is None or float(cosines.max()) >= least))
                found.append(lang if lang is not None or cosines is None else langs[int(cosines.argmax())])
            columns = [pa.array(found, pa.string()) if k == named else x for k, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
