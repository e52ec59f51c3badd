"""Secrets by character Markov models, with DataFrame functions only.

Two first-order Markov chains over characters are trained from labelled samples:
the random strings that base patterns mark as secrets, and the ordinary long
tokens of the corpus. A long token is a secret as well if the log-likelihood
ratio of the two chains over the whole token outweighs the odds against it, so
that short tokens must look more random than long ones.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.textspans import clear_of, count_kind, joined, spans

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Tokens that the models learn from and judge; numbers alone are not judged.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"
NUMBER = r"^[0-9+/_=-]*$"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Of so many ordinary tokens one is a secret.
ODDS = 1_000_000
#: So many pairs of each first character are taken from the chances of all characters.
BORROWED = 10


def base_spans(text: Column) -> Column:
    """The spans of all base patterns, by start, then by kind as listed. text is not null."""
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    assign = F.filter(
        spans(text, ASSIGN, "assign", 0, sign), lambda s: F.length(F.regexp_extract(s["value"], VALUE, 1)) >= 6
    )
    access = spans(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA")))
    return F.array_sort(F.concat(assign, access, spans(text, HEX, "hex", 2, F.lit(True))))


def _pairs(value: Column) -> Column:
    """Every two neighbouring characters of a text."""
    ends = F.sequence(F.lit(1), F.length(value) - 1)
    return F.when(F.length(value) >= 2, F.transform(ends, lambda i: F.substring(value, i, F.lit(2))))


def _values(base: Column) -> Column:
    """What is secret in base spans: the value of an assignment, else the whole."""
    return F.transform(base, lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["value"], VALUE, 1)).otherwise(s["value"]))


def fit(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of random against ordinary, for each pair of ALPHABET.

    Both chains learn from all rows in one pass: the random one from the base
    secrets, the ordinary one from the tokens that share no character with one.
    Words are counted before their pairs are; at most two counts for each pair
    come to the driver. Without documents all ratios are 0.
    """
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("t", base_spans(F.col("t")).alias("base"))
    # places are looked up only in texts that have a secret
    rows = rows.select("t", "base", spans(F.col("t"), TOKEN, "", 9, F.size("base") > 0).alias("placed"))
    beside = F.transform(clear_of(F.col("placed"), F.col("base")), lambda s: s["value"])
    ordinary = F.when(F.size("base") > 0, beside).otherwise(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)))
    labelled = lambda words, random: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(random).alias("random")))
    words = rows.select(F.explode(F.concat(labelled(_values(F.col("base")), True), labelled(ordinary, False))).alias("x")).select("x.w", "x.random")
    words = words.groupBy("w", "random").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select(F.explode(_pairs(F.col("w"))).alias("pair"), "random", "n").where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    seen: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for pair, random, n in pairs.groupBy("pair", "random").agg(F.sum("n").alias("n")).collect():
        seen[random][pair] = n
    return [x - y for x, y in zip(_chain(seen[True]), _chain(seen[False]))]


def _chain(seen: dict[str, int]) -> list[float]:
    """Log chances of each pair of ALPHABET after its first character; rare first characters borrow the chances of all."""
    letters = {b: sum(seen.get(a + b, 0) for a in ALPHABET) + 1 for b in ALPHABET}
    total, table = sum(letters.values()), []
    for a in ALPHABET:
        n = sum(seen.get(a + b, 0) for b in ALPHABET)
        table += [math.log((seen.get(a + b, 0) + BORROWED * letters[b] / total) / (n + BORROWED)) for b in ALPHABET]
    return table


def ratio(value: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a text over ALPHABET, the sum over its pairs; 0 if it has no pair."""
    held = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<float>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    n = F.length(value) - 1
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.get(held, (place(i) - 1) * len(ALPHABET) + place(i + 1) - 1)
    )
    return F.when(n >= 1, total).otherwise(0.0)


def secrets(docs: DataFrame, table: list[float], odds: float = ODDS) -> DataFrame:
    """One row per document: doc_id, found (all spans), base (those of base patterns).

    Spans that only the Markov models find have the kind `random`; they never
    overlap base ones. Null texts are empty. Repeated rows each get a row, and
    further columns are ignored. An empty table gives an empty result; texts are
    read whole, however long.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    suspect = lambda w: ~w.rlike(NUMBER) & (ratio(w, table) >= math.log(odds))
    tokens = F.array_distinct(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", "t", base_spans(F.col("t")).alias("base"), F.exists(tokens, suspect).alias("any"))
    # places are looked up only in texts that have a suspect
    placed = F.filter(spans(F.col("t"), TOKEN, "random", 3, F.col("any")), lambda s: suspect(s["value"]))
    rows = rows.select("doc_id", "base", placed.alias("placed"))
    return rows.select("doc_id", F.array_sort(F.concat("base", clear_of(F.col("placed"), F.col("base")))).alias("found"), "base")


def scan(docs: DataFrame) -> DataFrame:
    """Trains on docs and scans them, see fit() and secrets()."""
    return secrets(docs, fit(docs))


def report(rows: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
