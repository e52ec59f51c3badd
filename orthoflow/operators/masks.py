"""Class and validity masks over rasters (r, c)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.functions.raster import recode

#: Cloud classes: cloud, shadow or snow, water.
CLOUDY = (2, 4, 5)


def threshold_clouds(band: DataFrame, value: str = "v", threshold: float = 2000) -> DataFrame:
    """cls 1 (clear) up to the threshold, 2 (cloud) above it; null stays null."""
    v = F.col(value)
    return band.withColumn("cls", F.when(v.isNull(), None).when(v <= threshold, 1).otherwise(2))


def cloud_cover(classes: DataFrame, cloudy: Sequence[int] = CLOUDY, keys: Sequence[str] = ()) -> DataFrame:
    """Share of cloudy cells among those with a class other than 0, by scene."""
    seen = F.count_if(F.col("cls") != 0)
    return classes.groupBy(*keys).agg(F.try_divide(F.count_if(F.col("cls").isin(*cloudy)), seen).alias("covered"))


def clear_scenes(scenes: DataFrame, classes: DataFrame, key: str, cloudy: Sequence[int] = CLOUDY, most: float = 0.7) -> DataFrame:
    """Scenes of which at most that share is covered."""
    passed = cloud_cover(classes, cloudy, [key]).where(F.col("covered") <= most)
    return scenes.join(passed.select(key), key, "left_semi")


def valid_mask(a: DataFrame, b: DataFrame, value: str = "v", no_data: float = 0) -> DataFrame:
    """255 where both rasters have data, else 0; cells of one raster alone are invalid."""
    both = a.select("r", "c", F.col(value).alias("va")).join(b.select("r", "c", F.col(value).alias("vb")), ["r", "c"], "full")
    bad = F.col("va").isNull() | F.col("vb").isNull() | (F.col("va") == no_data) | (F.col("vb") == no_data)
    return both.select("r", "c", F.when(bad, 0).otherwise(255).alias("mask"))


def combine_masks(a: DataFrame, b: DataFrame, cloudy: Sequence[int] = (0, 2, 4, 5)) -> DataFrame:
    """255 where both class rasters are clear, else 0."""
    left = a.select("r", "c", recode(F.col("cls"), list(cloudy)).alias("ma"))
    right = b.select("r", "c", recode(F.col("cls"), list(cloudy)).alias("mb"))
    clear = (F.col("ma") == 0) & (F.col("mb") == 0)
    return left.join(right, ["r", "c"]).select("r", "c", F.when(clear, 255).otherwise(0).alias("mask"))


def valid_fraction(df: DataFrame, value: str, warn: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Masked share of a value, and whether it is over the limit."""
    masked = F.avg(F.col(value).isNull().cast("int"))
    return df.groupBy(*keys).agg(masked.alias("masked"), (masked > warn).alias("too_few"))
