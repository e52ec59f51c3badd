from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text) or longer rows; n_chars and the rest may be left out."""

    def make(rows, extra=False):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that operators use inside
            for name in ("fp", "n", "item", "term", "pos", "content", "salt", "text_hash", "bucket", "label", "kind", "value", "start", "end", "v", "w"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
