"""Collocations from count tries that are merged by prefix range.

Each shard of the texts counts its phrases in a trie of depth four: the sorted
different paths of up to four words with their counts, whose beginnings are the
inner nodes. The tries are cut at sampled splitters into prefix ranges, serialised
sorted, and merged range by range. A walk over a merged range gives the counts of
all nodes; those on its two borders, which a neighbour may hold as well, are
summed once more. Counts of left parts are those of nodes above, and suffix links
(joins on the phrase without its first words) give the right parts.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import hashed_below, stored, train_fraction

DEPTH = 4
LEAST = 30
BEST = 2000
#: Words that one trie of a shard is made from, and bytes of text for each prefix range.
SHARD_WORDS, RANGE_BYTES = 1 << 20, 8 << 20
#: Texts and, of each, phrases that splitters are sampled from.
SAMPLED_TEXTS, SAMPLED_PHRASES = 2_000, 25
#: Parts of each language that are ranked before the best of all parts are.
PARTS = 64
NO_LANG = "und"
_BREAK = b"."
#: A-Z in lower case, tabs as spaces, and whatever parts pieces as a line feed.
_TABLE = bytes(
    0x0A if chr(c) in ".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)

#: A path is a tuple of a language and DEPTH words; shorter phrases end in empty words.
Path = tuple[bytes, ...]


def split_words(text: bytes) -> list[bytes]:
    """Words of a text in lower case, with a full stop, which no word can be, behind each piece."""
    return [*filter(None, (text.translate(_TABLE).replace(b"\n", b" . ") + b" .").split(b" "))]


class Trie:
    """Different paths of one language and their counts, sorted.

    words are sorted, without repeats; paths has a row for each path, with numbers
    of words from 1 on and zeros behind the last one.
    """

    def __init__(self, words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.paths, self.counts = words, paths, counts

    @classmethod
    def of_texts(cls, texts: list[list[bytes]]) -> Trie:
        """Counts the phrases of texts from split_words()."""
        words = sorted({w for t in texts for w in t} - {_BREAK})
        number = dict(zip(words, range(1, len(words) + 1))) | {_BREAK: 0}
        line = np.fromiter((number[w] for t in texts for w in t), np.int64)
        place = np.flatnonzero(line)
        padded = np.r_[line, np.zeros(DEPTH, np.int64)]
        paths = np.empty((len(place), DEPTH), np.int64)
        live = np.ones(len(place), bool)
        for k in range(DEPTH):
            paths[:, k] = padded[place + k] * live
            live &= paths[:, k] > 0
        return cls(words, paths, np.ones(len(place), np.int64)).summed()

    def summed(self) -> Trie:
        """Sorted, and equal paths as one."""
        v = np.int64(len(self.words) + 1)
        first, second = self.paths[:, 0] * v + self.paths[:, 1], self.paths[:, 2] * v + self.paths[:, 3]
        by = np.lexsort((second, first))
        first, second = first[by], second[by]
        begins = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])][: len(by)])
        counts = np.add.reduceat(self.counts[by], begins) if len(by) else self.counts
        return Trie(self.words, self.paths[by[begins]], counts)

    def path(self, k: int) -> Path:
        return tuple(self.words[w - 1] if w else b"" for w in self.paths[k].tolist())

    def cut(self, lang: bytes, splitters: list[Path]) -> list[tuple[int, int, int]]:
        """(range, from, until) for the rows of each prefix range that has any."""
        own = [(k, s[1:]) for k, s in enumerate(splitters) if s[0] == lang]
        below = bisect_left(splitters, (lang,))  # splitters of languages before
        edges = [0, *(bisect_left(range(len(self.paths)), s, key=self.path) for _, s in own), len(self.paths)]
        return [(below + i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def serialised(self, a: int, b: int) -> tuple[bytes, bytes]:
        """Rows a to b as their words and their numbers, a column behind the other."""
        paths = self.paths[a:b]
        used, own = np.unique(paths, return_inverse=True)
        words = b"\n".join(self.words[w - 1] if w else b"" for w in used.tolist())
        columns = np.concatenate([own.reshape(paths.shape).T.ravel(), self.counts[a:b]])
        # bytes of one place together, so that the compression of the shuffle finds runs
        return words, columns.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    @classmethod
    def merged(cls, parts: list[tuple[bytes, bytes]]) -> Trie:
        """One trie from serialised ones."""
        lists = [w.split(b"\n") for w, _ in parts]
        words = sorted(set().union(*lists) - {b""})
        number = dict(zip(words, range(1, len(words) + 1))) | {b"": 0}
        paths, counts = [], []
        for own, (_, columns) in zip(lists, parts):
            numbers = np.frombuffer(columns, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
            table = numbers.reshape(DEPTH + 1, -1)
            paths.append(np.fromiter((number[w] for w in own), np.int64)[table[:DEPTH].T])
            counts.append(table[DEPTH])
        return cls(words, np.concatenate(paths), np.concatenate(counts)).summed()

    def nodes(self, least: int) -> Iterator[tuple[bytes, int, int]]:
        """Phrase, words, count of all nodes of at least that count and of those on the borders."""
        same = np.ones(len(self.paths) - 1, bool)
        for depth in range(1, DEPTH + 1):
            same &= self.paths[1:, depth - 1] == self.paths[:-1, depth - 1]
            begins = np.flatnonzero(np.r_[True, ~same])
            counts = np.add.reduceat(self.counts, begins)
            ended = self.paths[begins, depth - 1] == 0
            told = (counts >= least) & ~ended
            told[[0, -1]] = ~ended[[0, -1]]
            for k, n in zip(begins[told].tolist(), counts[told].tolist()):
                yield b" ".join(self.path(k)[:depth]), depth, n


def _sampled_splitters(docs: DataFrame, ranges: int) -> list[Path]:
    """ranges - 1 splitters at most, from phrases of a bounded sample of texts."""
    share = train_fraction(docs.count(), SAMPLED_TEXTS)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = split_words(text)
                places = random.Random(len(words)).choices(range(len(words)), k=SAMPLED_PHRASES) if words else []
                for i in places:
                    own = words[i : i + DEPTH]
                    own = own[: own.index(_BREAK)] if _BREAK in own else own
                    if own:
                        rows.append([lang.encode(), *own, *[b""] * (DEPTH - len(own))])
            yield pa.RecordBatch.from_pydict({"path": rows}, pa.schema([("path", pa.list_(pa.binary()))]))

    few = docs.where(hashed_below(share, "lang", "text")).dropDuplicates().limit(4 * SAMPLED_TEXTS)
    sample = sorted({tuple(bytes(w) for w in r["path"]) for r in few.mapInArrow(phrases, "path array<binary>").collect()})
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, phrase, words, f of all phrases of one to four words that occur at least that often, and n, the words of the lang."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splitters = _sampled_splitters(rows, max(12, -(-total // range_bytes)))

    def count_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list[bytes]]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in sorted(held.items()):
                trie = Trie.of_texts(texts)
                for number, a, b in trie.cut(lang.encode(), splitters):
                    words, columns = trie.serialised(a, b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([lang]), pa.array([words], pa.binary()), pa.array([columns], pa.binary())],
                        ["range", "lang", "names", "numbers"],
                    )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = split_words(text.as_py())
                held.setdefault(lang, []).append(words)
                n += len(words)
                if n >= shard_words:
                    yield from flush()
                    n = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            trie = Trie.merged(parts)
            found = [*trie.nodes(least), (b"", 0, int(trie.counts.sum()))]
            phrase, depth, n = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[1]] * len(found)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(depth, pa.int32()), pa.array(n, pa.int64())],
                ["lang", "phrase", "words", "f"],
            )

        for batch in batches:
            for number, lang, names, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (number, lang):
                    yield from close()
                    parts = []
                key = (number, lang)
                parts.append((names, numbers))
        if parts:
            yield from close()

    tries = rows.mapInArrow(count_tries, "range int, lang string, names binary, numbers binary")
    ranged = tries.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions("range", "lang")
    nodes = ranged.mapInArrow(merge, "lang string, phrase string, words int, f long")
    counted = stored(nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")), "phrases")
    sizes = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return counted.where((F.col("words") > 0) & (F.col("f") >= least)).join(sizes, "lang")


def _part(a: int | F.Column, n: int | F.Column) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), a, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more of phrase_counts() with l, r and score of their lowest-scoring cut."""
    f = counts.select("lang", "phrase", "f")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), "n")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", _part(F.lit(1), F.col("k"))).withColumn("right", _part(F.col("k") + 1, F.col("words")))
    linked = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    linked = linked.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = "CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    least = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "a", "n", "words")).alias("cut")
    return linked.groupBy("lang", "phrase").agg(least).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score", "cut.words")


def without_parts(found: DataFrame) -> DataFrame:
    """found without phrases that lie inside a longer one with at least 80 % of their count."""
    longer = found.where("words > 2").select("lang", "words", "phrase", F.col("a").alias("more"))
    spans = F.expr("transform(filter(sequence(0, words * words - 1), x -> x % words + 1 >= 2 AND x % words + 1 < words AND x div words + x % words + 1 <= words), x -> array(x div words, x % words + 1))")
    inside = longer.withColumn("span", F.explode(spans))
    inside = inside.select("lang", _part(F.expr("CAST(span[0] AS INT) + 1"), F.expr("CAST(span[1] AS INT)")).alias("phrase"), "more")
    most = inside.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    held = F.expr("CAST(more AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * 80")
    return found.join(most, ["lang", "phrase"], "left").where(F.col("more").isNull() | ~held).drop("more")


def collocations(
    docs: DataFrame, least: int = LEAST, best: int = BEST, shard_words: int = SHARD_WORDS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The best phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what spaces and tabs part, in lower case (A-Z), inside pieces parted
    by `.,;:!?` and line ends. The score of a cut is floor(2000000 a / (l + r)), of
    the counts a of a phrase and l, r of its two parts, and that of a phrase the
    lowest of its cuts (of ties the first). Phrases inside a longer one that has
    80 % of their count or more are dropped. Ties of score go by count, then by
    the bytes of the phrase. A null lang is `und`; null and empty texts have no
    words; repeated rows count each; further columns are ignored; a table without
    phrases gives no row. A very long text is split in one task.
    """
    from pyspark.sql import Window

    found = without_parts(stored(scored(phrase_counts(docs, least, shard_words, range_bytes)), "scored"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
