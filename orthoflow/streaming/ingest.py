"""Stack statistics kept up to date as new layers arrive.

An extension for continuous ingest: a file source of layers, sums by pixel in
complete mode, and the same final projections as the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orthoflow.operators.windows import mark_na

SCHEMA = "r int, c int, k int, ew double, ns double, cc int"


def layer_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Layers that are added to a folder as Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_sums(layers: DataFrame, min_cc: float) -> DataFrame:
    """Sums and counts by pixel; the state is a row for each pixel, whatever the number of layers."""
    return mark_na(layers, min_cc).groupBy("r", "c").agg(
        F.sum("ew").alias("ew"), F.sum("ns").alias("ns"), F.sum("na").alias("na"), F.count(F.lit(1)).alias("layers")
    )


def magnitudes(sums: DataFrame) -> DataFrame:
    """Mean magnitude of what has arrived so far."""
    used = F.col("layers") - F.col("na")
    return sums.withColumn("mean_magn", F.sqrt(F.try_divide(F.col("ew"), used) ** 2 + F.try_divide(F.col("ns"), used) ** 2))


def start(layers: DataFrame, name: str, checkpoint: str, min_cc: float = 0.333) -> StreamingQuery:
    """Keeps the sums in an in-memory table; for production use foreachBatch with a table of your own."""
    return (
        running_sums(layers, min_cc)
        .writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    )


