"""Corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoflow.llm import langid
from orthoflow.llm.decontamination import drop_contaminated
from orthoflow.llm.exact_dedup import drop_duplicates
from orthoflow.llm.packing import pack
from orthoflow.llm.queries import table, word_tokenizer
from orthoflow.llm.scratch import Tables
from orthoflow.llm.simhash import drop_near_duplicates

#: No SQL: the language profiles, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that was learned go; the others get theirs where none is given."""
    return langid.drop_unidentified(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences."""
    return pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", clean),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each of them keeps is written before the next one reads it.

    As soon as a stage's rows are written, the tables that led to them, those of
    the stage before included, are deleted from the shared folder. Only tables of
    this run are.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Tables(spark)
        with Tables(spark):
            docs = own.stored(stage(spark, docs, sf_dir), name)
        if before:
            before.release()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
