"""Fix-point fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions.raster import linspace, mask_low_cc
from orthoflow.operators import statistics as S
from orthoflow.operators.gridding import zoom_out
from orthoflow.plans.fixtures import LAYER, TILES, layer, table, tiles
from orthoflow.plans.measured import clip_sql, rounded
from orthoflow.plans.registry import query
from orthoflow.sources.scratch import stored


def surface(spark, sf_dir):
    """Rows x, y, z of an offset surface."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 25 - 1).alias("x"), (F.col("l_discount") / 0.05 - 1).alias("y"), (F.col("l_extendedprice") / 1000).alias("z")
    )


SURFACE = "pts AS MATERIALIZED (SELECT l_quantity / 25 - 1 AS x, l_discount / 0.05::DOUBLE - 1 AS y, l_extendedprice / 1000 AS z FROM lineitem)"


def plane_sql(points: str, steps: int) -> str:
    """CTEs b0..b<steps> (a, b, c) and m0..m<steps> (m) of a robust plane through `points`."""
    det = lambda q: (f"({q[0]} * ({q[4]} * {q[8]} - {q[5]} * {q[7]}) - {q[1]} * ({q[3]} * {q[8]} - {q[5]} * {q[6]})"  # noqa: E731
                     f" + {q[2]} * ({q[3]} * {q[7]} - {q[4]} * {q[6]}))")  # fmt: skip
    base, v = ["sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "s1"], ["sxz", "syz", "sz"]
    put = lambda k: [v[i // 3] if i % 3 == k else base[i] for i in range(9)]
    out = []
    for i in range(steps + 1):
        if i == 0:
            weight, more = "1.0::DOUBLE", ""
        else:
            r = "abs(a * x + b * y + c - z) / (6.9460::DOUBLE * m)"
            weight = f"CASE WHEN {r} > 1 OR {r} = 0 THEN 0.0::DOUBLE ELSE (1 - {r} * {r}) * (1 - {r} * {r}) END"
            more = f", b{i - 1}, m{i - 1}"
        out.append(f"""w{i} AS MATERIALIZED (SELECT x, y, z, {weight} AS w FROM {points}{more}),
s{i} AS MATERIALIZED (SELECT sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * x) AS sx, sum(w * y * y) AS syy, sum(w * y) AS sy, sum(w) AS s1,
  sum(w * x * z) AS sxz, sum(w * y * z) AS syz, sum(w * z) AS sz FROM w{i}),
b{i} AS MATERIALIZED (SELECT {det(put(0))} / {det(base)} AS a, {det(put(1))} / {det(base)} AS b, {det(put(2))} / {det(base)} AS c FROM s{i}),
m{i} AS MATERIALIZED (SELECT quantile_cont(abs(a * x + b * y + c - z), 0.5) AS m FROM {points}, b{i})""")
    return ",\n".join(out)


@query(f"WITH {SURFACE}, {plane_sql('pts', 3)} SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM b3")
def plane_fit(spark, sf_dir):
    p = S.fit_plane(stored(surface(spark, sf_dir), "surface"), iterations=3)
    return rounded(spark.createDataFrame([(p.a, p.b, p.c)], "a double, b double, c double"), "a", "b", "c")


@query(f"WITH {SURFACE}, {plane_sql('pts', 3)} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, round(m, 6) AS mad FROM m{i}" for i in range(4)))
def plane_mad_trace(spark, sf_dir):
    p = S.fit_plane(stored(surface(spark, sf_dir), "surface"), iterations=3)
    return rounded(spark.createDataFrame(list(enumerate(p.trace)), "step int, mad double"), "mad")


@query(f"""WITH RECURSIVE sample AS MATERIALIZED (SELECT value AS v FROM events), {clip_sql("g", "sample")}
SELECT round(mu, 6) AS mu, round(sg, 6) AS sigma, round(rmse, 6) AS rmse, n, CAST(rounds AS INTEGER) AS rounds FROM g""")
def gaussian_clip(spark, sf_dir):
    g = S.gaussian_clip(stored(table(spark, sf_dir, "events").select("value"), "values"), "value")
    return rounded(
        spark.createDataFrame([(g.mu, g.sigma, g.rmse, g.n, g.rounds)], "mu double, sigma double, rmse double, n long, rounds int"), "mu", "sigma", "rmse"
    )


@query(f"""WITH {TILES}, p AS (SELECT tile, -1.0::DOUBLE + 2.0::DOUBLE * c / 7 AS x, -1.0::DOUBLE + 2.0::DOUBLE * r / 7 AS y, v AS z FROM tiles),
s AS (SELECT tile, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * z) AS sxz, sum(y * z) AS syz, sum(z) AS sz, count(z) AS n FROM p GROUP BY tile)
SELECT tile, round(sxz / sxx, 6) AS a, round(syz / syy, 6) AS b, round(sz / n, 10) AS c FROM s""")
def tile_plane_fit(spark, sf_dir):
    """The tiles' grids are symmetric, so the SQL needs no determinants."""
    points = tiles(spark, sf_dir).select("tile", linspace(F.col("c"), 8).alias("x"), linspace(F.col("r"), 8).alias("y"), F.col("v").alias("z"))
    return rounded(S.tile_planes(points, "tile"), "a", "b").withColumn("c", F.round("c", 10))


ZOOMED = """zoomed AS (SELECT r // 4 AS r, c // 4 AS c, avg(ew) AS ew, CAST(round_even(avg(cc), 0) AS INTEGER) AS cc FROM layer GROUP BY ALL),
pts AS MATERIALIZED (SELECT -1.0::DOUBLE + 2.0::DOUBLE * c / 15 AS x, -1.0::DOUBLE + 2.0::DOUBLE * r / 15 AS y, ew AS z FROM zoomed
  WHERE (cc - 127) / 128.0 >= -0.6 AND abs(ew) <= 50)"""
STATS = "round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rmse, round(max(v), 6) AS max, round(min(v), 6) AS min, count(v) AS n"


@query(f"""WITH {LAYER}, {ZOOMED}, {plane_sql('pts', 3)}, stages AS (SELECT 'input' AS stage, z AS v FROM pts
  UNION ALL SELECT 'plane_corrected', z - (a * x + b * y + c) FROM pts, b3) SELECT stage, {STATS} FROM stages GROUP BY stage""")
def deramp(spark, sf_dir):
    """Statistics before and after a robust plane is taken off a zoomed, masked layer."""
    z = zoom_out(layer(spark, sf_dir), 4, ["ew"], ["cc"])
    pts = z.select(
        linspace(F.col("c"), 16).alias("x"), linspace(F.col("r"), 16).alias("y"), mask_low_cc(F.col("ew"), F.col("cc"), -0.6).alias("z")
    )
    pts = stored(pts.where(F.abs("z") <= 50), "points")
    p = S.fit_plane(pts, iterations=3)
    stages = pts.select(F.lit("input").alias("stage"), F.col("z").alias("v")).unionByName(
        pts.select(F.lit("plane_corrected").alias("stage"), (F.col("z") - p.at(F.col("x"), F.col("y"))).alias("v"))
    )
    return rounded(S.stage_statistics(stages, "v", ["stage"]), "mean", "std", "rmse", "max", "min")
