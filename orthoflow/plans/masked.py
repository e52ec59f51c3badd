"""Masks and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.operators import geometry, masks
from orthoflow.operators.statistics import outlier_mask as outliers, stage_statistics
from orthoflow.plans.fixtures import CLASSES, GRID, LAYER, classes, grid, layer, table
from orthoflow.plans.registry import query


@query(f"WITH {GRID} SELECT r, c, k, CASE WHEN (cc - 127) / 128.0 >= -0.3 THEN CAST(ew AS DOUBLE) END AS ew FROM grid")
def cc_mask_py(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", "k", R.mask_low_cc(F.col("ew").cast("double"), F.col("cc"), -0.3).alias("ew"))


@query(f"WITH {GRID} SELECT r, c, k, CASE WHEN cc >= 0.1 * 128 + 127 THEN CAST(ns AS DOUBLE) END AS ns FROM grid")
def cc_mask_raw(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", "k", R.mask_low_cc_raw(F.col("ns").cast("double"), F.col("cc"), 0.1).alias("ns"))


@query(f"WITH {GRID} SELECT r, c, k, round((cc - 128) / 127.0, 6) AS cc FROM grid")
def cc_decode_c(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", "k", F.round(R.cc_stack(F.col("cc")), 6).alias("cc"))


@query(f"WITH {GRID} SELECT r, c, k, CASE WHEN abs(ew) <= 4 THEN CAST(ew AS DOUBLE) END AS ew FROM grid")
def mask_large(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", "k", R.mask_large(F.col("ew").cast("double"), -4).alias("ew"))


@query(f"WITH {GRID} SELECT r, c, k, CASE WHEN ns BETWEEN -1 AND 1 THEN CAST(ns AS DOUBLE) END AS ns FROM grid")
def min_max_filter(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", "k", R.within(F.col("ns").cast("double"), -1, 1).alias("ns"))


@query(f"""WITH {GRID} SELECT k, round(avg(CAST((cc - 127) / 128.0 < -0.3 AS INTEGER)), 6) AS masked,
    avg(CAST((cc - 127) / 128.0 < -0.3 AS INTEGER)) > 0.5 AS too_few FROM grid GROUP BY k""")
def valid_fraction(spark, sf_dir):
    masked = grid(spark, sf_dir).withColumn("ew", R.mask_low_cc(F.col("ew"), F.col("cc"), -0.3))
    return masks.valid_fraction(masked, "ew", keys=["k"]).withColumn("masked", F.round("masked", 6))


@query(f"WITH {GRID} SELECT r, c, k, CASE WHEN cc <= 100 THEN 1 ELSE 2 END AS cls FROM grid")
def cloud_threshold(spark, sf_dir):
    return masks.threshold_clouds(grid(spark, sf_dir), "cc", 100).select("r", "c", "k", "cls")


@query(f"WITH {CLASSES} SELECT r, c, CASE WHEN cls IN (2, 4, 5) THEN 1 ELSE 0 END AS mask FROM classes")
def recode_mask(spark, sf_dir):
    return classes(spark, sf_dir).select("r", "c", R.recode(F.col("cls"), [2, 4, 5]).alias("mask"))


@query(f"""WITH {CLASSES}, {GRID}, other AS (SELECT r, c, abs(max(ew)) % 6 AS cls FROM grid GROUP BY r, c)
SELECT r, c, CASE WHEN a.cls NOT IN (0, 2, 4, 5) AND b.cls NOT IN (0, 2, 4, 5) THEN 255 ELSE 0 END AS mask
FROM classes a JOIN other b USING (r, c)""")
def combine_masks(spark, sf_dir):
    other = grid(spark, sf_dir).groupBy("r", "c").agg((F.abs(F.max("ew")) % 6).alias("cls"))
    return masks.combine_masks(classes(spark, sf_dir), other)


@query(f"WITH {CLASSES} SELECT round(count(*) FILTER (cls IN (2, 4, 5)) / nullif(count(*) FILTER (cls <> 0), 0), 6) AS covered FROM classes")
def cloud_check(spark, sf_dir):
    return masks.cloud_cover(classes(spark, sf_dir)).select(F.round("covered", 6).alias("covered"))


@query("""WITH cells AS (SELECT l_linenumber AS scene, p_size % 6 AS cls FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT scene FROM cells GROUP BY scene HAVING count(*) FILTER (cls IN (2, 4, 5)) <= 0.6 * count(*) FILTER (cls <> 0)""")
def filter_by_cloud(spark, sf_dir):
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cells = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_linenumber").alias("scene"), (F.col("p_size") % 6).alias("cls"))
    return masks.clear_scenes(items.select(F.col("l_linenumber").alias("scene")).distinct(), cells, "scene", most=0.6)


@query(f"""WITH {GRID}, a AS (SELECT r, c, ew AS v FROM grid WHERE k = 1), b AS (SELECT r, c, ns AS v FROM grid WHERE k = 2)
SELECT r, c, CASE WHEN a.v IS NULL OR b.v IS NULL OR a.v = 0 OR b.v = 0 THEN 0 ELSE 255 END AS mask FROM a FULL JOIN b USING (r, c)""")
def no_data_mask(spark, sf_dir):
    a = layer(spark, sf_dir, 1).select("r", "c", F.col("ew").alias("v"))
    b = layer(spark, sf_dir, 2).select("r", "c", F.col("ns").alias("v"))
    return masks.valid_mask(a, b)


@query(f"""WITH {GRID}, s AS (SELECT stddev_pop(ew) AS sg FROM grid)
SELECT r, c, k, CASE WHEN ew < 2.575 * sg AND ew > -2.575 * sg THEN CAST(ew AS DOUBLE) END AS ew FROM grid, s""")
def outlier_mask(spark, sf_dir):
    g = grid(spark, sf_dir)
    sigma = stage_statistics(g, "ew").first()["std"]
    return g.select("r", "c", "k", outliers(F.col("ew").cast("double"), sigma).alias("ew"))


@query(f"WITH {LAYER} SELECT r, c, CASE WHEN c BETWEEN 10 AND 30 AND r BETWEEN 5 AND 40 THEN 255 ELSE cc END AS mask FROM layer")
def add_to_mask(spark, sf_dir):
    ring = [(10, 5), (30, 5), (30, 40), (10, 40), (10, 5)]
    return geometry.burn(layer(spark, sf_dir).select("r", "c", F.col("cc").alias("mask")), ring)


@query(f"WITH {LAYER} SELECT r, c, cc / 10000.0 AS reflectance FROM layer")
def reflectance(spark, sf_dir):
    return layer(spark, sf_dir).select("r", "c", (F.col("cc") / F.lit(10000.0)).alias("reflectance"))
