"""One-pass statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import statistics as S
from orthoflow.operators.gridding import warp_parameters, zoom_out
from orthoflow.functions.raster import mask_low_cc
from orthoflow.plans.fixtures import GRID, LAYER, grid, layer, table
from orthoflow.plans.registry import query
from orthoflow.sources.scratch import stored


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {GRID} SELECT k, round(avg(ew), 6) AS mean, round(stddev_pop(ew), 6) AS std, round(sqrt(avg(ew * ew)), 6) AS rmse,
max(ew) AS max, min(ew) AS min, count(ew) AS n FROM grid GROUP BY k""")
def stage_stats(spark, sf_dir):
    return rounded(S.stage_statistics(grid(spark, sf_dir), "ew", ["k"]), "mean", "std", "rmse")


@query(f"WITH {GRID} SELECT r, c, round(stddev_pop(ew), 6) AS std FROM grid GROUP BY r, c")
def stack_std(spark, sf_dir):
    return rounded(S.stack_std(grid(spark, sf_dir), "ew"), "std")


@query("""WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sg FROM events)
SELECT CAST(least(floor((value - (mu - 3 * sg)) / (6 * sg) * 100) + 1, 100) AS BIGINT) AS bin, count(*) AS n FROM events, s
WHERE value BETWEEN mu - 3 * sg AND mu + 3 * sg GROUP BY ALL""")
def histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    m = S.stage_statistics(events, "value").first()
    return S.histogram(events, "value", m["mean"] - 3 * m["std"], m["mean"] + 3 * m["std"])


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def ols_r2(spark, sf_dir):
    return rounded(S.regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), "slope", "intercept", "r2")


@query("""WITH counted AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
SELECT min(p_brand) AS p_brand FROM counted WHERE n = (SELECT max(n) FROM counted)""")
def mode_projection(spark, sf_dir):
    return S.most_common(table(spark, sf_dir, "part"), "p_brand")


@query("""WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
SELECT min(p_partkey) AS p_partkey FROM part
WHERE p_brand = (SELECT min(p_brand) FROM b WHERE n = (SELECT max(n) FROM b)) AND p_type = (SELECT min(p_type) FROM t WHERE n = (SELECT max(n) FROM t))""")
def master_selection(spark, sf_dir):
    """The first scene that has both the commonest projection and the commonest grid."""
    parts = table(spark, sf_dir, "part")
    modes = parts.agg(F.mode("p_brand", True).alias("b"), F.mode("p_type", True).alias("t"))
    both = parts.join(F.broadcast(modes), (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("t")))
    return both.agg(F.min("p_partkey").alias("p_partkey"))


@query("""WITH bands AS (SELECT CASE p_size % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 ELSE 60.0 END AS g FROM part)
SELECT DISTINCT CAST(g AS DOUBLE) AS res, 300000.0::DOUBLE + round_even(CAST((300013.0 - 300000.0) / g AS DOUBLE), 0) * g AS xmin,
4900020.0::DOUBLE + round_even(CAST((4900000.0 - 4900020.0) / -g AS DOUBLE), 0) * -g AS ymax,
CAST(round_even(CAST(601 / (g / 10.0) AS DOUBLE), 0) AS INTEGER) AS out_cols, CAST(round_even(CAST(451 / (-g / -10.0) AS DOUBLE), 0) AS INTEGER) AS out_rows FROM bands""")
def distinct_params(spark, sf_dir):
    g = F.when(F.col("p_size") % 3 == 0, 10.0).when(F.col("p_size") % 3 == 1, 20.0).otherwise(60.0)
    bands = table(spark, sf_dir, "part").select(
        g.alias("g_xres"), (-g).alias("g_yres"), F.lit(300000.0).alias("g_ulx"), F.lit(4900020.0).alias("g_uly"),
        F.lit(300013.0).alias("ulx"), F.lit(4900000.0).alias("uly"), F.lit(10.0).alias("xres"), F.lit(-10.0).alias("yres"),
        F.lit(451).alias("rows"), F.lit(601).alias("cols"),
    )
    return warp_parameters(bands)


def clip_sql(name: str, source: str) -> str:
    """Recursive CTEs that clip source.v; {name} has one row mu, sg, n, rmse, rounds."""
    return f"""{name}_it(i, lo, hi, mu, sg, n, rmse, ch) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), CAST('inf' AS DOUBLE), avg(v), stddev_pop(v), count(v), sqrt(avg(v * v)), CAST('inf' AS DOUBLE) FROM {source}
  UNION ALL
  SELECT i + 1, greatest(lo, mu - 2.575 * sg), least(hi, mu + 2.575 * sg), avg(v), stddev_pop(v), count(v), sqrt(avg(v * v)), sg - stddev_pop(v)
  FROM {name}_it, {source} WHERE i < 100 AND ch >= 0.005 AND v > greatest(lo, mu - 2.575 * sg) AND v < least(hi, mu + 2.575 * sg)
  GROUP BY i, lo, hi, mu, sg
), {name} AS (SELECT mu, sg, n, rmse, i AS rounds FROM {name}_it ORDER BY i DESC LIMIT 1)"""


@query(f"""WITH RECURSIVE {LAYER}, zoomed AS (SELECT r // 4 AS r, c // 4 AS c, avg(ew) AS px1, avg(ns) AS px2, CAST(round_even(avg(cc), 0) AS INTEGER) AS cc
  FROM layer GROUP BY ALL), kept AS MATERIALIZED (SELECT px1, px2 FROM zoomed WHERE (cc - 127) / 128.0 >= -0.6), s1 AS (SELECT px1 AS v FROM kept), s2 AS (SELECT px2 AS v FROM kept),
{clip_sql("c1", "s1")}, {clip_sql("c2", "s2")}
SELECT round(sqrt(avg(px1 * px1 + px2 * px2)), 6) AS rmse_xy, count(*) AS n FROM kept, c1, c2
WHERE abs(px1 - c1.mu) < 2.575 * c1.sg AND abs(px2 - c2.mu) < 2.575 * c2.sg""")
def rmse_xy(spark, sf_dir):
    zoomed = zoom_out(layer(spark, sf_dir), 4, ["ew", "ns"], ["cc"])
    kept = zoomed.select(
        mask_low_cc(F.col("ew"), F.col("cc"), -0.6).alias("px1"), mask_low_cc(F.col("ns"), F.col("cc"), -0.6).alias("px2")
    )
    kept = stored(kept, "kept")
    return rounded(S.rmse_xy(kept, S.gaussian_clip(kept, "px1"), S.gaussian_clip(kept, "px2")), "rmse_xy")
