"""De-striping and the end-to-end correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import correction as C
from orthoflow.operators import gridding as G
from orthoflow.plans.fixtures import EDGES, GRID, LAYER, SIDE, grid, layer, rings
from orthoflow.plans.gridded import CANVAS, TURN, TURN_SQL
from orthoflow.plans.iterated import STATS, plane_sql
from orthoflow.plans.measured import rounded
from orthoflow.plans.registry import query

P = C.CorrectionParameters(SIDE, SIDE, cc_threshold=-0.6, max_displacement=50)

_A, _B, _C, _D, _E, _F = TURN.inverse
FORWARD = f"""forward AS (SELECT r, c, ew,
  CAST(floor({_A!r}::DOUBLE * (c - {_E!r}::DOUBLE) + {_C!r}::DOUBLE * (r - {_F!r}::DOUBLE) + 0.5) AS INTEGER) AS rc,
  CAST(floor({_B!r}::DOUBLE * (c - {_E!r}::DOUBLE) + {_D!r}::DOUBLE * (r - {_F!r}::DOUBLE) + 0.5) AS INTEGER) AS rr FROM layer)"""
ROTATED = f"{LAYER}, {TURN_SQL}, rotated AS (SELECT t.r, t.c, l.ew AS got FROM turned t LEFT JOIN layer l ON l.r = sr AND l.c = sc), {FORWARD}"


@query(f"""WITH {ROTATED}, profile AS (SELECT c AS rc, quantile_cont(got, 0.5) AS m FROM rotated GROUP BY c)
SELECT r, c, ew - coalesce(m, 0) AS v FROM forward LEFT JOIN profile USING (rc)""")
def destripe_along(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("ew").cast("double").alias("v"))
    return G.destripe(src, SIDE, SIDE, 12.0).select("r", "c", "v")


@query(f"""WITH {ROTATED}, pc AS (SELECT c AS rc, quantile_cont(got, 0.5) AS m FROM rotated GROUP BY c), pr AS (SELECT r AS rr, quantile_cont(got, 0.5) AS n FROM rotated GROUP BY r)
SELECT r, c, ew - coalesce(m, 0) - coalesce(n, 0) AS v FROM forward LEFT JOIN pc USING (rc) LEFT JOIN pr USING (rr)""")
def destripe_across(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("ew").cast("double").alias("v"))
    return G.destripe(src, SIDE, SIDE, 12.0, across=True).select("r", "c", "v")


ACROSS = """WITH {0}, pc AS (SELECT c AS rc, {1} AS m FROM rotated WHERE got IS NOT NULL GROUP BY c), pr AS (SELECT r AS rr, {1} AS n FROM rotated WHERE got IS NOT NULL GROUP BY r)
SELECT r, c, round(ew - coalesce(m, 0) - coalesce(n, 0), 6) AS v FROM forward LEFT JOIN pc USING (rc) LEFT JOIN pr USING (rr)"""


def _across(spark, sf_dir, option):
    src = layer(spark, sf_dir).select("r", "c", F.col("ew").cast("double").alias("v"))
    return rounded(G.destripe(src, SIDE, SIDE, 12.0, across=True, option=option).select("r", "c", "v"), "v")


@query(ACROSS.format(ROTATED, "avg(got)"))
def destripe_mean(spark, sf_dir):
    """Column and row means taken off."""
    return _across(spark, sf_dir, "mean")


@query(ACROSS.format(ROTATED + ", counted AS (SELECT r, c, got FROM rotated)", "list_sort(list_filter(map_keys(histogram(got)), lambda k: histogram(got)[k] = list_max(map_values(histogram(got)))))[1]"))
def destripe_mode(spark, sf_dir):
    """Column and row modes taken off, the smallest of equally common values."""
    return _across(spark, sf_dir, "mode")


def side(r: str, c: str) -> str:
    return f"(x2 - x1) * ({r} - y1) - ({c} - x1) * (y2 - y1)"


def zone_sql(source: str, name: str) -> str:
    """CTE: r, c of `source` with the highest detector that holds them."""
    s = side("l.r", "l.c")
    return f"""{name}_held AS (SELECT l.r, l.c, det_id FROM {source} l, edges GROUP BY l.r, l.c, det_id
  HAVING bool_or({s} = 0 AND l.c BETWEEN least(x1, x2) AND greatest(x1, x2) AND l.r BETWEEN least(y1, y2) AND greatest(y1, y2))
  OR count(*) FILTER ((y1 > l.r) <> (y2 > l.r) AND (CASE WHEN y2 > y1 THEN {s} > 0 ELSE {s} < 0 END)) % 2 = 1),
{name} AS (SELECT r, c, max(det_id) AS det_id FROM {name}_held GROUP BY r, c)"""


ESTIMATE = f"""{EDGES}, {LAYER}, small AS (SELECT r // 4 AS r, c // 4 AS c, avg(ew) AS v, CAST(round_even(avg(cc), 0) AS INTEGER) AS cc FROM layer GROUP BY ALL),
kept AS MATERIALIZED (SELECT r * 4 + 2 AS r, c * 4 + 2 AS c, -1.0::DOUBLE + 2.0::DOUBLE * c / 15 AS x, -1.0::DOUBLE + 2.0::DOUBLE * r / 15 AS y, v AS z
  FROM small WHERE (cc - 127) / 128.0 >= -0.6 AND abs(v) <= 50),
pts AS MATERIALIZED (SELECT x, y, z FROM kept), {plane_sql('pts', 3)},
flat AS (SELECT k.r, k.c, z, z - (b3.a * x + b3.b * y + b3.c) AS v FROM kept k, b3), {zone_sql('flat', 'zoned')},
residuals AS (SELECT det_id, v FROM flat JOIN zoned USING (r, c)), offsets AS (SELECT det_id, quantile_cont(v, 0.5) AS m FROM residuals GROUP BY det_id)"""


def field(spark, sf_dir):
    return layer(spark, sf_dir).select("r", "c", F.col("ew").cast("double").alias("v"), "cc")


@query(f"""WITH {ESTIMATE}, stages AS (SELECT 'input' AS stage, z AS v FROM flat UNION ALL SELECT 'plane_corrected', v FROM flat
  UNION ALL SELECT 'destripe', v - m FROM residuals JOIN offsets USING (det_id)) SELECT stage, {STATS} FROM stages GROUP BY stage""")
def correction_log(spark, sf_dir):
    found = C.estimate(field(spark, sf_dir), rings(spark), P)
    return rounded(found.log, "mean", "std", "rmse", "max", "min")


FINE = "-1.0::DOUBLE + 2.0::DOUBLE * (({} + 0.5::DOUBLE) / 4 - 0.5) / 15"


@query(f"""WITH {ESTIMATE}, {zone_sql('layer', 'fine')}, corrected AS (
  SELECT l.r, l.c, l.cc, ew - (b3.a * ({FINE.format('l.c')}) + b3.b * ({FINE.format('l.r')}) + b3.c) - coalesce(m, 0) AS v
  FROM layer l LEFT JOIN fine f ON f.r = l.r AND f.c = l.c LEFT JOIN offsets USING (det_id), b3)
SELECT r, c, round(CASE WHEN (cc - 127) / 128.0 >= -0.6 AND abs(v) <= 50 THEN v END, 6) AS v FROM corrected""")
def correction_pipeline(spark, sf_dir):
    one = field(spark, sf_dir)
    return rounded(C.apply(one, C.estimate(one, rings(spark), P), rings(spark), P), "v")


def planes_sql(points: str, steps: int) -> str:
    """CTEs b0..b<steps> (g, a, b, c) and m0..m<steps> (g, m) of a robust plane for each group g of `points`."""
    det = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
    base, v, out = ["sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "s1"], ["sxz", "syz", "sz"], []
    put = lambda k: det.format(*[v[i // 3] if i % 3 == k else base[i] for i in range(9)])
    for i in range(steps + 1):
        r = "abs(a * x + b * y + c - z) / (6.9460::DOUBLE * m)"
        weight = f"CASE WHEN {r} > 1 OR {r} = 0 THEN 0.0::DOUBLE ELSE (1 - {r} * {r}) * (1 - {r} * {r}) END" if i else "1.0::DOUBLE"
        keep = "CASE WHEN m >= 1e-5 THEN {0} ELSE {1} END" if i else "{0}"
        more = f" JOIN b{i - 1} USING (g) JOIN m{i - 1} USING (g)" if i else ""
        out.append(f"""w{i} AS MATERIALIZED (SELECT g, x, y, z, {weight} AS w FROM {points}{more}),
s{i} AS MATERIALIZED (SELECT g, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * x) AS sx, sum(w * y * y) AS syy, sum(w * y) AS sy, sum(w) AS s1,
  sum(w * x * z) AS sxz, sum(w * y * z) AS syz, sum(w * z) AS sz FROM w{i} GROUP BY g),
b{i} AS MATERIALIZED (SELECT g, {keep.format(f"{put(0)} / {det.format(*base)}", "a")} AS a, {keep.format(f"{put(1)} / {det.format(*base)}", "b")} AS b,
  {keep.format(f"{put(2)} / {det.format(*base)}", "c")} AS c FROM s{i}{more}),
m{i} AS MATERIALIZED (SELECT g, quantile_cont(abs(a * x + b * y + c - z), 0.5) AS m FROM {points} JOIN b{i} USING (g) GROUP BY g)""")
    return ",\n".join(out)


PAIRS = f"""{EDGES}, {GRID}, long AS (SELECT k || ':px1' AS g, k, r, c, CAST(ew AS DOUBLE) AS v, cc FROM grid UNION ALL SELECT k || ':px2', k, r, c, CAST(ns AS DOUBLE), cc FROM grid),
small AS (SELECT g, r // 4 AS r, c // 4 AS c, avg(v) AS z, CAST(round_even(avg(cc), 0) AS INTEGER) AS cc FROM long GROUP BY ALL),
kept AS MATERIALIZED (SELECT g, r * 4 + 2 AS r, c * 4 + 2 AS c, -1.0::DOUBLE + 2.0::DOUBLE * c / 15 AS x, -1.0::DOUBLE + 2.0::DOUBLE * r / 15 AS y, z
  FROM small WHERE (cc - 127) / 128.0 >= -0.6 AND abs(z) <= 50), pts AS MATERIALIZED (SELECT g, x, y, z FROM kept), {planes_sql('pts', 3)},
flat AS (SELECT g, p.r, p.c, z - (b3.a * x + b3.b * y + b3.c) AS v FROM kept p JOIN b3 USING (g)),
centres AS (SELECT DISTINCT r, c FROM flat), {zone_sql('centres', 'zoned')},
residuals AS (SELECT g, det_id, v FROM flat JOIN zoned USING (r, c)), offsets AS (SELECT g, det_id, quantile_cont(v, 0.5) AS m FROM residuals GROUP BY g, det_id),
places AS (SELECT DISTINCT r, c FROM grid), {zone_sql('places', 'fine')}, moved AS (
  SELECT l.g, l.k, l.r, l.c, l.cc, l.v - (b3.a * ({FINE.format('l.c')}) + b3.b * ({FINE.format('l.r')}) + b3.c) - coalesce(m, 0) AS v
  FROM long l JOIN b3 USING (g) LEFT JOIN fine f ON f.r = l.r AND f.c = l.c LEFT JOIN offsets o ON o.g = l.g AND o.det_id = f.det_id),
masked AS (SELECT g, k, r, c, CASE WHEN (cc - 127) / 128.0 >= -0.6 AND abs(v) <= 50 THEN v END AS v FROM moved),
wide AS (SELECT k, r, c, max(v) FILTER (g LIKE '%px1') AS px1, max(v) FILTER (g LIKE '%px2') AS px2 FROM masked GROUP BY k, r, c)"""


def pairs(spark, sf_dir):
    """All layers of the grid as pairs of both axes."""
    return grid(spark, sf_dir).select("k", "r", "c", F.col("ew").alias("px1"), F.col("ns").alias("px2"), "cc")


@query(f"WITH {PAIRS} SELECT k, r, c, round(px1, 6) AS px1, round(px2, 6) AS px2 FROM wide")
def correct_all(spark, sf_dir):
    """Both axes of all layers: robust planes, detector offsets and masks in one plan."""
    return rounded(C.correct_all(pairs(spark, sf_dir), "k", rings(spark), P).fields, "px1", "px2")


@query(f"""WITH RECURSIVE {PAIRS}, left_over AS MATERIALIZED (SELECT g, v - m AS v FROM residuals JOIN offsets USING (g, det_id)), clipped(g, i, lo, hi, mu, sg, ch) AS (
  SELECT g, 0, CAST('-inf' AS DOUBLE), CAST('inf' AS DOUBLE), avg(v), stddev_pop(v), CAST('inf' AS DOUBLE) FROM left_over GROUP BY g
  UNION ALL
  SELECT t.g, i + 1, greatest(lo, mu - 2.575 * sg), least(hi, mu + 2.575 * sg), avg(v), stddev_pop(v), sg - stddev_pop(v)
  FROM clipped t JOIN left_over l ON l.g = t.g AND i < 100 AND ch >= 0.005 AND v > greatest(lo, mu - 2.575 * sg) AND v < least(hi, mu + 2.575 * sg) GROUP BY t.g, i, lo, hi, mu, sg
), sigmas AS (SELECT g, arg_max(sg, i) AS sg FROM clipped GROUP BY g),
near AS (SELECT w.k, px1, px2 FROM wide w JOIN sigmas a ON a.g = w.k || ':px1' JOIN sigmas b ON b.g = w.k || ':px2' WHERE abs(px1) < 2.575 * a.sg AND abs(px2) < 2.575 * b.sg)
SELECT k, round(sqrt(avg(px1 * px1 + px2 * px2)), 6) AS rmse_xy, count(*) AS n FROM near GROUP BY k""")
def output_rmse(spark, sf_dir):
    """The error that is left in each corrected pair, both axes together."""
    return rounded(C.correct_all(pairs(spark, sf_dir), "k", rings(spark), P).errors, "rmse_xy")


BASE = {"ulx": 0.0, "uly": 64.0, "xres": 1.0, "yres": -1.0, "rows": SIDE, "cols": SIDE}
COARSE = {"ulx": 0.0, "uly": 64.0, "xres": 2.0, "yres": -2.0, "rows": SIDE // 2, "cols": SIDE // 2}


@query(f"""WITH {LAYER}, cells AS (SELECT CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c FROM range(64) t(a), range(64) u(b)),
px AS (SELECT r, c, CASE WHEN ew IS NULL THEN 0 ELSE least(greatest(ew, -6), 6) / 2.0 END AS px, CASE WHEN ns IS NULL THEN 0 ELSE least(greatest(ns, -6), 6) / 2.0 END AS py FROM cells LEFT JOIN layer USING (r, c)),
half AS (SELECT r // 2 AS r, c // 2 AS c, max(cc) AS v FROM layer GROUP BY ALL),
asked AS (SELECT 'fine' AS band, r, c, px, py FROM px UNION ALL SELECT 'coarse', (r - 1) // 2, (c - 1) // 2, px / 2, py / 2 FROM px WHERE r % 2 = 1 AND c % 2 = 1),
bands AS (SELECT 'fine' AS band, r, c, cc AS v FROM layer UNION ALL SELECT 'coarse', r, c, v FROM half)
SELECT a.band, a.r, a.c, coalesce(b.v, 0) AS v FROM asked a
LEFT JOIN bands b ON b.band = a.band AND b.r = CAST(round_even(a.r + py, 0) AS INTEGER) AND b.c = CAST(round_even(a.c + px, 0) AS INTEGER)""")
def correct_bands(spark, sf_dir):
    """Two bands of different resolutions moved by one pair's offsets, nearest cells."""
    one = layer(spark, sf_dir)
    small = lambda x: F.least(F.greatest(F.col(x), F.lit(-6)), F.lit(6)) / 2.0
    offsets = one.select("r", "c", small("ew").alias("px1"), small("ns").alias("px2"))
    half = one.groupBy(F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.max("cc").alias("v"))
    bands = {"fine": (one.select("r", "c", F.col("cc").alias("v")), BASE), "coarse": (half, COARSE)}
    return C.correct_bands(bands, offsets, BASE, nearest=True)
