"""Footprint geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.operators import geometry as Y
from orthoflow.operators.overlay import overlay_areas
from orthoflow.operators.pairing import bbox_overlaps
from orthoflow.plans.fixtures import EDGES, LAYER, layer, rings, supplier_edges, supplier_rings, table
from orthoflow.plans.registry import query

SIDE_OF = "(x2 - x1) * (l.r - y1) - (l.c - x1) * (y2 - y1)"
ZONES = f"""{EDGES}, {LAYER}, held AS (
  SELECT l.r, l.c, l.ew, det_id FROM layer l, edges GROUP BY l.r, l.c, l.ew, det_id
  HAVING bool_or({SIDE_OF} = 0 AND l.c BETWEEN least(x1, x2) AND greatest(x1, x2) AND l.r BETWEEN least(y1, y2) AND greatest(y1, y2))
  OR count(*) FILTER ((y1 > l.r) <> (y2 > l.r) AND (CASE WHEN y2 > y1 THEN {SIDE_OF} > 0 ELSE {SIDE_OF} < 0 END)) % 2 = 1
), zoned AS (SELECT r, c, ew, max(det_id) AS det_id FROM held GROUP BY r, c, ew)"""


def zoned(spark, sf_dir):
    return Y.zones(layer(spark, sf_dir).select("r", "c", "ew"), rings(spark))


@query(f"WITH {ZONES} SELECT r, c, det_id FROM zoned")
def point_in_polygon(spark, sf_dir):
    return zoned(spark, sf_dir).select("r", "c", "det_id")


def _stats(option):
    def run(spark, sf_dir):
        out = Y.zone_statistics(zoned(spark, sf_dir), option, "ew", clip=20)
        return out.select("det_id", F.round(F.col("average").cast("double"), 6).alias("average"), F.round("std", 6).alias("std"), "n")

    run.__name__ = f"detector_stats_{option}"
    return run


for _option, _sql in {"mean": "round(avg(ew), 6)", "median": "quantile_cont(ew, 0.5)"}.items():
    query(f"WITH {ZONES} SELECT det_id, {_sql} AS average, round(stddev_pop(ew), 6) AS std, count(ew) AS n FROM zoned WHERE abs(ew) <= 20 GROUP BY det_id")(_stats(_option))
query(f"""WITH {ZONES}, counted AS (SELECT det_id, ew, count(*) AS n FROM zoned WHERE abs(ew) <= 20 GROUP BY ALL)
SELECT z.det_id, CAST((SELECT min(ew) FROM counted k WHERE k.det_id = z.det_id AND k.n = (SELECT max(n) FROM counted m WHERE m.det_id = z.det_id)) AS DOUBLE) AS average,
round(stddev_pop(ew), 6) AS std, count(ew) AS n FROM zoned z WHERE abs(ew) <= 20 GROUP BY z.det_id""")(_stats("mode"))


@query(f"""WITH {LAYER} SELECT r, c, CASE WHEN c + r >= 30 AND c + r <= 70 AND abs(c - r) <= 20 THEN cc ELSE -9999 END AS v FROM layer
WHERE c BETWEEN 5 AND 45 AND r BETWEEN 5 AND 45""")
def clip_raster(spark, sf_dir):
    diamond = [(5.2, 25.0), (25.0, 5.0), (45.0, 25.0), (25.0, 45.4), (5.2, 25.0)]
    return Y.clip(layer(spark, sf_dir).select("r", "c", F.col("cc").alias("v")), diamond)


BOXES = """boxes AS (SELECT s_suppkey AS id, s_nationkey AS xmin, s_nationkey + 3 + s_suppkey % 7 AS xmax, s_acctbal / 500 AS ymin, s_acctbal / 500 + 2 AS ymax FROM supplier)"""


def boxes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("xmin"), (F.col("s_nationkey") + 3 + F.col("s_suppkey") % 7).alias("xmax"),
        (F.col("s_acctbal") / 500).alias("ymin"), (F.col("s_acctbal") / 500 + 2).alias("ymax"),
    )


@query(f"""WITH {BOXES} SELECT max(xmin) AS xmin, min(xmax) AS xmax, round(max(ymin), 6) AS ymin, round(min(ymax), 6) AS ymax FROM boxes""")
def bbox_intersection(spark, sf_dir):
    """The box that all share; where there is none its minimum is above its maximum."""
    b = boxes(spark, sf_dir)
    return b.agg(F.max("xmin").alias("xmin"), F.min("xmax").alias("xmax"), F.round(F.max("ymin"), 6).alias("ymin"), F.round(F.min("ymax"), 6).alias("ymax"))


@query(f"""WITH {BOXES}, one AS (SELECT * FROM boxes WHERE id = (SELECT min(id) FROM boxes))
SELECT b.id FROM boxes b, one o WHERE greatest(b.xmin, o.xmin) < least(b.xmax, o.xmax) AND greatest(b.ymin, o.ymin) < least(b.ymax, o.ymax)""")
def bbox_semi_filter(spark, sf_dir):
    b = boxes(spark, sf_dir)
    one = F.broadcast(b.agg(F.min_by(F.struct("xmin", "xmax", "ymin", "ymax"), "id").alias("o")))  # one row
    names = ("xmin", "xmax", "ymin", "ymax")
    return b.join(one, bbox_overlaps({n: F.col(n) for n in names}, {n: F.col(f"o.{n}") for n in names}), "left_semi").select("id")


@query(f"""WITH {supplier_edges()}, a AS (SELECT 90 - degrees(atan2(abs(y2 - y1), abs(x2 - x1))) AS angle FROM edges)
SELECT round(avg(angle), 6) AS mean, round(stddev_pop(angle), 6) AS std, count(*) AS n FROM a WHERE angle NOT BETWEEN 89.5 AND 90.5 AND angle NOT BETWEEN -0.5 AND 0.5""")
def edge_angles(spark, sf_dir):
    return Y.stripe_angle(supplier_rings(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS k, l_quantity AS q, l_suppkey AS s,
  -(l_linenumber * 7 - 5 * (-(l_suppkey % 3 + 1.0::DOUBLE))) AS det FROM lineitem)
SELECT id, k, q, s, round(CASE WHEN det <> 0 THEN (q * 7 - 5 * (k + s)) / -det END, 6) AS x FROM l""")
def line_intersection(spark, sf_dir):
    """Where a x + b y = c of each row meets a second line of the row."""
    k, s = F.col("l_linenumber"), F.col("l_suppkey")
    p = F.struct(k.cast("double").alias("a"), F.lit(5.0).alias("b"), F.col("l_quantity").alias("c"))
    q = F.struct((-(s % 3 + 1)).cast("double").alias("a"), F.lit(7.0).alias("b"), (k + s).cast("double").alias("c"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), k.alias("k"), F.col("l_quantity").alias("q"), s.alias("s"), F.round(R.intersection(p, q)["x"], 6).alias("x")
    )


@query("""WITH p AS (SELECT DISTINCT l_quantity AS px, l_extendedprice AS py FROM lineitem),
t AS (SELECT px, py, ((px - 3) * 40 + (py - 100) * 9) / (40.0::DOUBLE * 40 + 81) AS t FROM p)
SELECT px, py, round(3 + t * 40, 6) AS x, round(100 + t * 9, 6) AS y FROM t""")
def project_point(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("px"), F.col("l_extendedprice").alias("py")).distinct()
    foot = R.project(F.col("px"), F.col("py"), *[F.lit(v) for v in (3.0, 100.0, 43.0, 109.0)])
    return p.select("px", "py", F.round(foot["x"], 6).alias("x"), F.round(foot["y"], 6).alias("y"))


@query(f"""WITH {EDGES}, {LAYER}, d AS (SELECT l.r, l.c, det_id, i, row_number() OVER (PARTITION BY l.r, l.c ORDER BY (x1 - l.c) ** 2 + (y1 - l.r) ** 2, det_id, i) AS rn FROM layer l, edges)
SELECT r, c, det_id, CAST(i AS INTEGER) AS i, CAST(rn AS INTEGER) AS rn FROM d WHERE rn <= 2""")
def nearest_two(spark, sf_dir):
    """The two nearest vertices of the footprints for each cell."""
    vertices = Y.edges(rings(spark)).select("det_id", "i", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return Y.nearest(layer(spark, sf_dir).select("r", "c"), vertices, 2)


def overlay_sql(shape: str, held: str, digits: int = 5) -> str:
    """Trapezoids of the pairs of one nation's footprints, by slabs: pieces (id_a, id_b, own area)."""
    return f"""WITH {supplier_edges(shape, "given")}, pairs AS (SELECT DISTINCT a.det_id AS id_a, b.det_id AS id_b FROM given a JOIN given b ON a.nation = b.nation AND a.det_id < b.det_id),
edges AS (SELECT id_a, id_b, second, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS x1, least(y1, y2) AS y1, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS x2, greatest(y1, y2) AS y2 FROM (
  SELECT id_a, id_b, 0 AS second, g.* FROM pairs JOIN given g ON g.det_id = id_a UNION ALL SELECT id_a, id_b, 1, g.* FROM pairs JOIN given g ON g.det_id = id_b) WHERE y1 <> y2),
cuts AS (SELECT a.id_a, a.id_b, a.y1 + ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / c * (a.y2 - a.y1) AS y
  FROM (SELECT a, b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS c FROM edges a JOIN edges b ON a.id_a = b.id_a AND a.id_b = b.id_b AND a.second = 0 AND b.second = 1)
  WHERE c <> 0 AND ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / c BETWEEN 0 AND 1 AND ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / c BETWEEN 0 AND 1),
heights AS (SELECT id_a, id_b, y1 AS y FROM edges UNION SELECT id_a, id_b, y2 FROM edges UNION SELECT * FROM cuts),
slabs AS (SELECT id_a, id_b, y AS s0, lead(y) OVER (PARTITION BY id_a, id_b ORDER BY y) AS s1 FROM heights),
beside AS (SELECT id_a, id_b, s0, s1, second, x1 + (x2 - x1) * (s0 - y1) / (y2 - y1) AS p, x1 + (x2 - x1) * (s1 - y1) / (y2 - y1) AS q
  FROM edges JOIN slabs USING (id_a, id_b) WHERE s1 - s0 > 1e-9 AND y1 < (s0 + s1) / 2 AND y2 > (s0 + s1) / 2),
told AS (SELECT *, sum(1 - second) OVER l % 2 = 1 AS a, sum(second) OVER l % 2 = 1 AS b, lead(p) OVER w + lead(q) OVER w - p - q AS wide FROM beside
  WINDOW w AS (PARTITION BY id_a, id_b, s0 ORDER BY p + q, p, second), l AS (PARTITION BY id_a, id_b, s0 ORDER BY p + q, p, second ROWS UNBOUNDED PRECEDING))
SELECT id_a, id_b, round(sum(wide / 2 * (s1 - s0)), {digits}) AS area, count(*) AS pieces FROM told WHERE wide > 1e-9 AND ({held}) GROUP BY id_a, id_b"""


@query(f"SELECT id_a, id_b, area FROM ({overlay_sql('convex', 'a AND b', 6)}) WHERE area > 1e-4")
def polygon_clip(spark, sf_dir):
    """Areas of the intersections of convex footprints."""
    got = Y.intersection_areas(supplier_rings(spark, sf_dir, "convex"))
    return got.select("id_a", "id_b", F.round("area", 6).alias("area")).where("area > 1e-4")


def _overlay(how):
    def run(spark, sf_dir):
        return overlay_areas(supplier_rings(spark, sf_dir, "dented"), how, digits=5)

    run.__name__ = f"polygon_{how}"
    return run


for _how, _held in {"both": "a AND b", "either": "a OR b", "first": "a AND NOT b"}.items():
    query(overlay_sql("dented", _held))(_overlay(_how))
