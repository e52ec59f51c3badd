"""Joins that survive a hot key, and samples of a bounded size.

stored() and Tables are those of orthoflow.sources.scratch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.sources.scratch import Tables, shared_dir, stored

__all__ = ["Tables", "attach", "fresh", "hashed_below", "least_of_ties", "labelled_sample", "shared_dir", "stored", "train_fraction"]

#: A group with more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 200


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it if df has a column of that name."""
    while name in df.columns:
        name += "_"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with a table of one row for each key, safe for hot keys.

    groups must be stored (it is read three times) and hold, in column size, the
    number of rows of its key. Hot keys are fewer than HOT_SHARE whatever the
    input, so they alone are broadcast; all other keys are shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > total
    few = groups.where(hot)
    return rows.join(F.broadcast(few), key).unionByName(
        rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.where(~hot), key)
    )


def least_of_ties(docs: DataFrame, ties: DataFrame, digest: Column) -> DataFrame:
    """docs, but of the rows of each tie one: the least by its text, then by its other columns in their order.

    ties has rows (_id, _digest), each once; a row is of a tie if its doc_id and
    digest are those. So the same row stays however the table is stored.
    """
    same = docs["doc_id"].eqNullSafe(ties["_id"]) & (digest == ties["_digest"])
    names = ["text", *(c for c in docs.columns if c != "text")]
    key, row = fresh(docs, "_key"), fresh(docs, "_row")
    own = docs.join(ties, same).select(F.struct("_id", "_digest").alias(key), F.struct(*(docs[c] for c in names)).alias(row))
    least = own.groupBy(key).agg(F.min(row).alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
    return docs.join(ties, same, "left_anti").unionByName(least)


def train_fraction(n: int, bound: int) -> float:
    """The share of n rows that a fit bounded to so many rows may read."""
    return 1.0 if n <= bound else bound / n


def hashed_below(fraction: float, *columns: Column | str) -> Column:
    """True for that fraction of the values of columns, always the same ones; any fraction above 2**-64 selects some."""
    below = round(fraction * 2**64) - 2**63  # of the signed 64-bit hashes
    return F.lit(True) if below >= 2**63 else F.xxhash64(*columns, F.lit("sample")) < F.lit(below)


def labelled_sample(docs: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """Stored rows of docs with their labels from own (a row for each doc_id): about `most` at most.

    Ids are chosen by their hash on both sides, so that the broadcast side has
    about `most` rows whatever the tables; rows that repeat each other count once,
    and if ids stand for many texts, rows are thinned by a hash of both.
    """
    share = train_fraction(own.count(), most)
    few = F.broadcast(own.where(hashed_below(share, "doc_id")))
    found = stored(docs.where(hashed_below(share, "doc_id")).join(few, "doc_id").dropDuplicates(), "labelled")
    return found.where(hashed_below(train_fraction(found.count(), most + most // 4), "doc_id", "text"))
