"""Scene pairs: sequences, stars, before and after, forward and backward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date(scenes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """scenes with rn, the place by date (ties by scene_id), within key columns if given.

    Without a key all scenes are one sequence: they are ranked within months, and
    a month's first place is the count of all before it. Months are few whatever
    the table, as dates are bounded.
    """
    order = ["date", "scene_id"]
    if key:
        return scenes.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    ranked = scenes.withColumn("_month", F.trunc("date", "month"))
    before = F.sum("_n").over(Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))
    months = ranked.groupBy("_month").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_month").alias("_m"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("_month").orderBy(*order)))
    out = ranked.join(F.broadcast(months), F.col("_month").eqNullSafe(F.col("_m")))
    return out.withColumn("rn", (F.col("_before") + F.col("_rn")).cast("int")).drop("_month", "_m", "_before", "_rn")


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct("scene_id", "date").alias(name), F.col("rn").alias(f"{name}_rn"))


def flat(pairs: DataFrame) -> DataFrame:
    """Columns ref_id, ref_date, sec_id, sec_date of pairs."""
    return pairs.select(
        F.col("ref.scene_id").alias("ref_id"), F.col("ref.date").alias("ref_date"),
        F.col("sec.scene_id").alias("sec_id"), F.col("sec.date").alias("sec_date"),
    )


def swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("sec").alias("ref"), F.col("ref").alias("sec"))


def sequence_pairs(scenes: DataFrame, match_range: int = 1, backward: bool = True) -> DataFrame:
    """Pairs of scenes at most match_range places apart by date; backward adds the swapped ones.

    An equi-join: each scene is offered under the places of its partners.
    """
    ranked = by_date(scenes)
    steps = F.sequence(F.lit(1), F.lit(match_range))
    ahead = _side(ranked, "ref").withColumn("sec_rn", F.explode(F.transform(steps, lambda k: F.col("ref_rn") + k)))
    pairs = ahead.join(_side(ranked, "sec"), "sec_rn").select("ref", "sec")
    return pairs.unionByName(swapped(pairs)) if backward else pairs


def star_pairs(scenes: DataFrame, date) -> DataFrame:
    """The one scene of that date with every other scene; another number of scenes there is an error."""
    ref = scenes.where(F.col("date") == F.lit(date)).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("scene_id", "date")).alias("ref")
    )
    one = ref.select(F.when(F.col("n") == 1, F.col("ref")).otherwise(F.raise_error(F.lit("no single scene of that date"))).alias("ref"))
    sec = scenes.select(F.struct("scene_id", "date").alias("sec"))
    # one row, whatever the input
    return sec.join(F.broadcast(one), F.col("ref.scene_id") != F.col("sec.scene_id")).select("ref", "sec")


def before_after_pairs(scenes: DataFrame, split, backward: bool = False) -> DataFrame:
    """Every scene before the date with every scene from it on: all pairs are the result asked for."""
    early = scenes.where(F.col("date") < F.lit(split)).select(F.struct("scene_id", "date").alias("ref"))
    late = scenes.where(F.col("date") >= F.lit(split)).select(F.struct("scene_id", "date").alias("sec"))
    pairs = early.join(late)
    return pairs.unionByName(swapped(pairs)) if backward else pairs


def forward_backward(pairs: DataFrame) -> DataFrame:
    """Each forward pair with its backward partner, once; pairs without a partner have no row."""
    p = flat(pairs)
    low, high = F.least("ref_id", "sec_id"), F.greatest("ref_id", "sec_id")
    both = p.groupBy(low.alias("first_id"), high.alias("second_id")).agg(
        F.count_if(F.col("ref_date") < F.col("sec_date")).alias("forward"), F.count_if(F.col("ref_date") > F.col("sec_date")).alias("back")
    )
    return both.where((F.col("forward") > 0) & (F.col("back") > 0)).select("first_id", "second_id")


def multitemporal(pairs: DataFrame, date1: str = "ref_date", date2: str = "sec_date") -> DataFrame:
    return pairs.where(F.col(date1) != F.col(date2))


def series_bounds(pairs: DataFrame) -> DataFrame:
    """First and last date of a series of pairs, and the days between."""
    start, end = F.min(F.least("ref_date", "sec_date")), F.max(F.greatest("ref_date", "sec_date"))
    return pairs.agg(start.alias("start"), end.alias("end"), F.datediff(end, start).alias("days"))


def bbox_overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes (xmin, xmax, ymin, ymax) share an area."""
    return (F.greatest(a["xmin"], b["xmin"]) < F.least(a["xmax"], b["xmax"])) & (
        F.greatest(a["ymin"], b["ymin"]) < F.least(a["ymax"], b["ymax"])
    )
