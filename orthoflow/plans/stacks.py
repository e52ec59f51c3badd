"""Displacement stacks: coherence, magnitude, velocity, missing counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators.windows import StackParameters, box, densify, mean_magnitude as magnitude, mean_velocity as velocity
from orthoflow.operators.windows import pixel_sums, vector_coherence as coherence
from orthoflow.plans.fixtures import GRID, LAYERS, SIDE, grid
from orthoflow.plans.registry import query

#: The fixture's bytes are mostly small; a lower limit keeps most of its vectors.
P = StackParameters(window=5, min_cc=-0.9)

SUMS = f"""WITH {GRID}, marked AS (
  SELECT r, c, k, CAST((cc - 128) / 127.0 < -0.9 AS INTEGER) AS na, CASE WHEN (cc - 128) / 127.0 < -0.9 THEN 0 ELSE ew END AS ew,
         CASE WHEN (cc - 128) / 127.0 < -0.9 THEN 0 ELSE ns END AS ns FROM grid
), px AS (
  SELECT r, c, CAST(sum(ew) AS BIGINT) AS ew, CAST(sum(ns) AS BIGINT) AS ns, sum(sqrt(ew * ew + ns * ns)) AS path, CAST(sum(na) AS BIGINT) AS na
  FROM marked GROUP BY r, c
), dense AS (
  SELECT r, c, coalesce(ew, 0) AS ew, coalesce(ns, 0) AS ns, coalesce(path, 0) AS path, coalesce(na, 0) AS na
  FROM (SELECT CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c FROM range(64) t(a), range(64) u(b)) LEFT JOIN px USING (r, c)
)"""
BOXES = SUMS + """, across AS (
  SELECT r, c, ew, ns, na, sum(ew) OVER w AS bew, sum(ns) OVER w AS bns, sum(path) OVER w AS bpath, sum(na) OVER w AS bna
  FROM dense WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
), boxes AS (
  SELECT r, c, ew, ns, na, sum(bew) OVER w AS bew, sum(bns) OVER w AS bns, sum(bpath) OVER w AS bpath, CAST(sum(bna) OVER w AS BIGINT) AS bna
  FROM across WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
)"""


@query(
    BOXES
    + """ SELECT r, c, round(CASE WHEN sqrt((ew / nullif(7 - na, 0)) ** 2 + (ns / nullif(7 - na, 0)) ** 2) > 0.15 AND na <= 7 * 0.6
    AND NOT bna > 25 * 7 * 0.4 THEN sqrt(bew * bew + bns * bns) / nullif(bpath, 0) ELSE 0 END, 6) AS vc FROM boxes"""
)
def vector_coherence(spark, sf_dir):
    out = coherence(grid(spark, sf_dir), P, LAYERS, SIDE, SIDE)
    return out.select("r", "c", F.round("vc", 6).alias("vc"))


@query(SUMS + " SELECT r, c, round(sqrt((ew / nullif(7 - na, 0)) ** 2 + (ns / nullif(7 - na, 0)) ** 2), 6) AS mean_magn FROM px")
def mean_magnitude(spark, sf_dir):
    out = magnitude(pixel_sums(grid(spark, sf_dir), P.min_cc), LAYERS)
    return out.select("r", "c", F.round("mean_magn", 6).alias("mean_magn"))


@query(SUMS + " SELECT r, c, na FROM px")
def na_count(spark, sf_dir):
    return pixel_sums(grid(spark, sf_dir), P.min_cc).select("r", "c", "na")


@query(BOXES + " SELECT r, c, bna AS na_block FROM boxes")
def na_count_block(spark, sf_dir):
    sums = densify(pixel_sums(grid(spark, sf_dir), P.min_cc).select("r", "c", "na"), SIDE, SIDE, {"na": 0})
    return box(sums, ["na"], P.window // 2).select("r", "c", F.col("b_na").alias("na_block"))


@query(
    SUMS
    + """ SELECT r, c, round(sum(ew / CAST(k AS DOUBLE)) / nullif(7 - sum(na), 0), 6) AS veloc_ew,
    round(sum(ns / CAST(k AS DOUBLE)) / nullif(7 - sum(na), 0), 6) AS veloc_ns FROM marked GROUP BY r, c"""
)
def mean_velocity(spark, sf_dir):
    out = velocity(grid(spark, sf_dir), P.min_cc, LAYERS, "k")
    return out.select("r", "c", F.round("veloc_ew", 6).alias("veloc_ew"), F.round("veloc_ns", 6).alias("veloc_ns"))


@query(f"WITH {GRID} SELECT r, c, CAST(sum(ew) AS BIGINT) AS ew FROM grid WHERE k IN (SELECT DISTINCT k FROM grid ORDER BY k LIMIT 3) GROUP BY r, c")
def layer_limit(spark, sf_dir):
    """The first layers by name only: a limit is what is asked for."""
    g = grid(spark, sf_dir)
    first = g.select("k").distinct().orderBy("k").limit(3)
    return g.join(F.broadcast(first), "k", "left_semi").groupBy("r", "c").agg(F.sum("ew").alias("ew"))
