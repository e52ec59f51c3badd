"""Toxicity by weak supervision.

Voters look at a text and at nothing else: insults that need no label, lexicons
of terms (words and word beginnings), and patterns of address, marks and case.
Labels choose the terms of the lexicons in a bounded sample, and no more. A
generative label model is fitted to the votes of all rows: it estimates each
voter's precision and the correlation of voters within a class, and gives each
combination of votes a posterior. A linear classifier over terms is trained on
the posterior labels of a bounded sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.langid import _rows_of, held_out
from orthoflow.llm.scratch import labelled_sample

#: So many labelled rows are read to choose terms, and the classifier is trained on their posteriors.
MAX_TRAIN_ROWS = 10_000
#: Lexicon voters, and the toxic rows that a term needs. There are at most 2**(voters) combinations of votes.
LEXICONS, SUPPORT = 14, 3
#: Terms of the classifier are toxic in half of their rows at least, or so many times rarer in toxic rows than in others.
CLEAN_ODDS = 4
#: Share of a lexicon term's labelled rows that are toxic, at least.
PRECISION = 0.8
PREFIXES = range(4, 10)
CACHED = 300_000
#: English insults that need no label.
SEEDS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown".split()
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bag_of(text: str | None) -> tuple[list[str], list[int], int]:
    """The different words of a text, their counts, and the number of all."""
    words = words_of(text)
    counts = Counter(words)
    return list(counts), list(counts.values()), len(words)


_ORDER = re.compile(r"\b(?:shut up|get lost|get out|go away|go to hell|screw you|drop dead)\b")
_TERMS = re.compile(r"\b(?:licen[sc]ed?|copyright|all rights reserved|terms of use)\b")
_YOU = {"you", "your", "youre", "ya", "tu", "toi", "vous", "du", "dich", "ihr", "usted", "eres"}
#: Voters beside the lexicons, with the precision that they are thought to have before any text is seen.
OTHERS = {"seeds": 0.8, "address": 0.5, "orders": 0.5, "marks": 0.2, "shouting": 0.2, "terms": 0.02}
VOTERS = [*OTHERS, *(f"lexicon{k}" for k in range(LEXICONS))]


def lexicon_voter(term: str) -> int:
    """The lexicon of a term; a hash deals them, so that each lexicon has terms of all languages."""
    return zlib.crc32(term.encode()) % LEXICONS


def voter(lexicon: list[str]) -> Callable[[str | None], int]:
    """A function that gives the votes of a text: bit k is set if voter k says toxic (of `terms`, clean)."""
    own = set(lexicon)
    seeds = set(SEEDS)
    cache: dict[str, int] = {}

    def bits_of(word: str) -> int:
        found = cache.get(word)
        if found is None:
            if len(cache) >= CACHED:
                cache.clear()
            found = 0
            for t in terms_of(word):
                if t in own:
                    found |= 1 << len(OTHERS) + lexicon_voter(t)
            cache[word] = found
        return found

    def votes(text: str | None) -> int:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        different = set(words)
        out = 0
        for word in different:
            out |= bits_of(word)
        if different & seeds:
            out |= 1
            if any(w in seeds and _YOU & set(words[max(i - 3, 0) : i + 4]) for i, w in enumerate(words)):
                out |= 2
        if _ORDER.search(low):
            out |= 4
        if "!!" in text or "?!" in text:
            out |= 8
        if low != text:
            loud = sum(w.isupper() for w in _WORD.findall(text) if len(w) > 2)
            if loud > 3 and 3 * loud > len(words):
                out |= 16
        if _TERMS.search(low):
            out |= 32
        return out

    return votes


@dataclass
class Model:
    """Weights by term and the bias; the lexicon; of the label model, each voter's precision, and correlations."""

    weights: dict[str, float]
    bias: float
    lexicon: list[str]
    precisions: dict[str, float]
    correlations: np.ndarray


def vectors(bags: Iterator[tuple], index: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the terms of each bag_of() a text: damped counts for its length."""
    cache: dict[str, tuple[int, ...]] = {}
    for words, counts, total in bags:
        held: Counter = Counter()
        for word, n in zip(words, counts):
            found = cache.get(word)
            if found is None:
                if len(cache) >= CACHED:
                    cache.clear()
                found = cache[word] = tuple(index[t] for t in terms_of(word) if t in index)
            for i in found:
                held[i] += n
        at = np.fromiter(held.keys(), np.int64, len(held))
        values = np.fromiter(held.values(), np.float64, len(held))
        yield at, np.log1p(values) * (1 + np.log1p(1000 * values / max(total, 50))) / 4


def label_model(
    votes: np.ndarray, counts: np.ndarray, thought: np.ndarray, rounds: int = 50, strength: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by combination of votes, the voters' precisions, and correlations within classes.

    votes: combinations by voters, 0 or 1; counts: rows of each combination;
    thought: the share of class 1 among the rows of a voter that is believed
    before, worth `strength` times the voter's rows. Expectation maximisation;
    each voter's log-odds are divided by its share of correlated voters, so that
    copies of one voter do not count as many.
    """
    votes = votes.astype(float)
    n, rows = counts.sum(), counts @ votes
    posterior = np.where(votes @ (thought >= 0.5) > 0, 0.8, 0.02)
    share, correlation = np.ones(votes.shape[1]), np.eye(votes.shape[1])
    for r in range(rounds):
        one = np.clip(counts @ posterior, 1e-3 * n, (1 - 1e-3) * n)
        prior = one / n
        precision = ((counts * posterior) @ votes + strength * thought * rows + thought) / ((1 + strength) * rows + 1)
        by = np.clip(np.stack([(1 - precision) * rows / (n - one), precision * rows / one]), 1e-9, 0.999)
        if r % 5 == 0:  # from the first round on, so that copies of a voter cannot lead
            rest = votes - by[0] - posterior[:, None] * (by[1] - by[0])
            size = np.sqrt(counts @ rest**2 / n) + 1e-9
            correlation = (rest * counts[:, None]).T @ rest / n / np.outer(size, size)
            share = 1 / np.maximum(1, np.where(correlation > 0.2, correlation, 0).sum(axis=1))
        given, absent = np.log(by[1]) - np.log(by[0]), np.log1p(-by[1]) - np.log1p(-by[0])
        z = math.log(prior / (1 - prior)) + (votes * given + (1 - votes) * absent) @ share
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, precision, correlation


def _bits(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] >> np.arange(len(VOTERS)) & 1


def posteriors(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """label_model() of combinations of votes as bits, with its precisions by name."""
    thought = np.array([*OTHERS.values(), *[PRECISION] * LEXICONS])
    posterior, precision, correlation = label_model(_bits(codes), counts.astype(float), thought)
    return posterior, dict(zip(VOTERS, precision.tolist())), correlation


def choose_lexicon(bags: list[tuple], labels: list[int]) -> list[str]:
    """Terms whose labelled rows are mostly toxic; of a term and its beginnings the shortest. The only use of labels."""
    have, inside = Counter(), Counter()
    for (words, _, _), label in zip(bags, labels):
        own = {t for w in words for t in terms_of(w)}
        have.update(own)
        if label:
            inside.update(own)
    good = {t for t, n in inside.items() if n >= SUPPORT and n >= PRECISION * have[t]}
    longer = lambda t: len(t) - (2 if t.endswith("*") else 1)  # noqa: E731  the longest beginning that is shorter than the term
    return sorted(t for t in good if not any(t[:k] + "*" in good for k in range(PREFIXES[0], longer(t) + 1)))


def learn(bags: list[tuple], posterior: np.ndarray, lexicon: list[str]) -> tuple[dict[str, float], float]:
    """Weights by term and bias of the classifier, from bag_of() texts and their posterior labels."""
    n1 = float(posterior.sum())
    n0 = len(posterior) - n1
    have, inside = Counter(), Counter()
    for (words, _, _), p in zip(bags, posterior.tolist()):
        for t in {t for w in words for t in terms_of(w)}:
            have[t] += 1
            inside[t] += p
    chosen = {*SEEDS, *lexicon}
    for t, n in have.items():
        one, rest = inside[t], n - inside[t]
        odds = math.log((one + 0.5) / (n1 + 1)) - math.log((rest + 0.5) / (n0 + 1))
        if one >= SUPPORT and one >= n / 2 or rest * n1 >= SUPPORT * n0 and odds <= -math.log(CLEAN_ODDS):
            chosen.add(t)
    index = {t: k for k, t in enumerate(sorted(chosen))}
    weights, bias = logistic(list(vectors(bags, index)), posterior, len(index))
    return {t: float(weights[k]) for t, k in index.items() if weights[k]}, bias


def logistic(x: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, epochs: int = 30, l2: float = 2e-5):
    """Weights and bias of a logistic regression on soft targets, by Adagrad over small batches."""
    rng = np.random.default_rng(5)
    w, b = np.zeros(size), float(np.log(target.mean() / (1 - target.mean() + 1e-9) + 1e-9))
    gw, gb = np.full(size, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            at = np.concatenate([x[i][0] for i in rows])
            value = np.concatenate([x[i][1] for i in rows])
            doc = np.repeat(np.arange(len(rows)), [len(x[i][0]) for i in rows])
            z = b + np.bincount(doc, w[at] * value, len(rows))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]
            g = np.bincount(at, error[doc] * value, size) / len(rows)
            seen = np.unique(at)
            g = g[seen] + l2 * w[seen]
            gw[seen] += g * g
            w[seen] -= 0.15 * g / np.sqrt(gw[seen])
            gb += error.mean() ** 2
            b -= 0.15 * error.mean() / math.sqrt(gb)
    return w, float(b)


def score_texts(texts: Iterator[str | None], model: Model) -> Iterator[float]:
    names = list(model.weights)
    index = {t: k for k, t in enumerate(names)}
    w = np.fromiter(model.weights.values(), float, len(names))
    for at, value in vectors(map(bag_of, texts), index):
        z = model.bias + float(w[at] @ value) if len(at) else model.bias
        yield 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that are not held out and have an id."""
    docs = docs.where(~held_out(4, 2) & F.col("doc_id").isNotNull())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """doc_id, text and label of labelled rows that are not held out, chosen by hashes, about `most` at most.

    Rows that repeat id and text count once, so that no repeated row exceeds the bound.
    """
    own = labels.where(~held_out(4, 2) & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    return labelled_sample(learnable(docs), own, most)


def vote_counts(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """Rows of docs for each combination of votes: votes (bits), n. At most 2**len(VOTERS) rows."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = voter(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for (t,) in _rows_of(batch)], pa.int32())], ["votes"])

    return docs.select("text").mapInArrow(vote, "votes int").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


_BAGS = "doc_id long, words array<string>, counts array<int>, total long, votes int, label int"


def _bags(sample: DataFrame, lexicon: list[str]) -> DataFrame:
    """Texts of a sample as bags of words and votes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, votes = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int32()], voter(lexicon)
        for batch in batches:
            rows = [(*bag_of(t), votes(t)) for (t,) in _rows_of(batch.select([1]))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(2)], [x.split()[0] for x in _BAGS.split(", ")])

    return sample.mapInArrow(make, _BAGS)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns from rows that are not held out. Without a labelled row the score is that of a low bias.

    One task chooses the lexicon from the labelled sample, all rows vote, the
    label model is fitted to the counts of their combinations, and one task trains
    the classifier on the sample's posteriors. Such a task holds the bags of words
    of at most about max_train_rows whole texts; only lexicon, combinations of
    votes and model come to the driver.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in _rows_of(b)]
        yield pa.RecordBatch.from_arrays([pa.array(choose_lexicon([r[1:4] for r in rows], [r[5] for r in rows]), pa.string())], ["term"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in _rows_of(b)), key=lambda r: (r[0], r[3], r[1], r[2]))
        weights, bias = learn([r[1:4] for r in rows], np.array([of[r[4]] for r in rows]), lexicon)
        made = [pa.array([list(weights)], pa.list_(pa.string())), pa.array([list(weights.values())], pa.list_(pa.float64())), pa.array([bias])]
        yield pa.RecordBatch.from_arrays(made, ["terms", "weights", "bias"])

    sample = training_sample(docs, labels, target, max_train_rows)
    if sample.isEmpty():
        return Model({}, -2.0, [], {}, np.zeros((0, 0)))
    lexicon = sorted(r["term"] for r in _bags(sample, []).repartition(1).mapInArrow(choose, "term string").collect())
    combined = sorted(map(tuple, vote_counts(learnable(docs), lexicon).collect()))
    codes, counts = (np.array(x, np.int64) for x in zip(*combined))
    posterior, precisions, correlations = posteriors(codes, counts)
    of = dict(zip(codes.tolist(), posterior.tolist()))
    schema = "terms array<string>, weights array<double>, bias double"
    terms, weights, bias = _bags(sample, lexicon).repartition(1).mapInArrow(train, schema).first()
    return Model(dict(zip(terms, weights)), bias, lexicon, precisions, correlations)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Null and empty texts have no term and get the score of the bias. Repeated
    rows each get a row; only doc_id and text are read, texts as a whole. An
    empty table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter(score_texts((t for (t,) in _rows_of(batch.select([1]))), model), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double, predicted int")
