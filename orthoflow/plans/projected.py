"""Changes of projection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import projection as P
from orthoflow.operators import geometry as Y
from orthoflow.operators import gridding as G
from orthoflow.operators.pairing import bbox_overlaps
from orthoflow.plans.fixtures import GRID, LAYER, grid, layer, table
from orthoflow.plans.registry import query


def _sum(factors: list[float], first: str, second: str, a: str, b: str) -> str:
    return " + ".join(f"{f!r}::DOUBLE * {first}({2 * k} * {a}) * {second}({2 * k} * {b})" for k, f in enumerate(factors, 1))


def degrees_sql(source: str, out: str, x: str, y: str, zone: str) -> str:
    """CTEs that add lon and lat to the rows of source."""
    e = "(180 / pi())"
    lat = " + ".join(f"{f!r}::DOUBLE * sin({2 * k} * chi)" for k, f in enumerate(P.series(P._LATITUDE), 1))
    return f"""{out}1 AS (SELECT *, {y} / {P.RADIUS!r}::DOUBLE AS xi, ({x} - 500000) / {P.RADIUS!r}::DOUBLE AS eta FROM {source}),
{out}2 AS (SELECT *, xi - ({_sum(P.series(P._FROM), 'sin', 'cosh', 'xi', 'eta')}) AS p, eta - ({_sum(P.series(P._FROM), 'cos', 'sinh', 'xi', 'eta')}) AS q FROM {out}1),
{out}3 AS (SELECT *, asin(sin(p) / cosh(q)) AS chi FROM {out}2),
{out} AS (SELECT * EXCLUDE (xi, eta, p, q, chi), {zone} * 6 - 183 + atan2(sinh(q), cos(p)) * {e} AS lon, (chi + {lat}) * {e} AS lat FROM {out}3)"""


def plane_sql(source: str, out: str, zone: str) -> str:
    """CTEs that add east and north of lon and lat to the rows of source."""
    e, d = f"{P.ECCENTRICITY!r}::DOUBLE", "(pi() / 180)"
    return f"""{out}1 AS (SELECT *, sinh(atanh(sin(lat * {d})) - {e} * atanh({e} * sin(lat * {d}))) AS t, (lon - ({zone} * 6 - 183)) * {d} AS away FROM {source}),
{out}2 AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM {out}1),
{out} AS (SELECT * EXCLUDE (t, away, xi, eta), 500000 + {P.RADIUS!r}::DOUBLE * (eta + {_sum(P.series(P._TO), 'cos', 'sinh', 'xi', 'eta')}) AS east,
  {P.RADIUS!r}::DOUBLE * (xi + {_sum(P.series(P._TO), 'sin', 'cosh', 'xi', 'eta')}) AS north FROM {out}2)"""


_PLACES = f"WITH {GRID}, places AS (SELECT r, c, k, 30 + k AS zone, 300000 + c * 6000.0::DOUBLE AS x, 4900020 - r * 9000.0::DOUBLE AS y FROM grid)"


@query(f"""{_PLACES}, {degrees_sql('places', 'd', 'x', 'y', 'zone')}, {plane_sql('d', 'm', 'zone')}
SELECT r, c, k, round(lon, 8) AS lon, round(lat, 8) AS lat, abs(east - x) < 1e-6 AND abs(north - y) < 1e-6 AS same FROM m""")
def plane_to_degrees(spark, sf_dir):
    """The cells of all layers, each in a zone of its own, in degrees and back."""
    at = grid(spark, sf_dir).select("r", "c", "k", (F.lit(300000.0) + F.col("c") * 6000.0).alias("x"), (F.lit(4900020.0) - F.col("r") * 9000.0).alias("y"))
    zone = F.col("k") + 30
    moved = at.withColumn("d", P.to_degrees(F.col("x"), F.col("y"), zone))
    moved = moved.withColumn("m", P.to_plane(F.col("d.lon"), F.col("d.lat"), zone))
    same = (F.abs(F.col("m.x") - F.col("x")) < 1e-6) & (F.abs(F.col("m.y") - F.col("y")) < 1e-6)
    return moved.select("r", "c", "k", F.round("d.lon", 8).alias("lon"), F.round("d.lat", 8).alias("lat"), same.alias("same"))


#: Boxes of suppliers in zone 32, of 3 to 9 km by 40 km.
_CORNERS = """box AS (SELECT s_suppkey AS id, 250000 + s_nationkey * 24000.0::DOUBLE AS xmin, 250000 + s_nationkey * 24000.0::DOUBLE + 3000 + s_suppkey % 7 * 1000 AS xmax,
  5000000 + s_acctbal * 60.0::DOUBLE AS ymin, 5000000 + s_acctbal * 60.0::DOUBLE + 40000 AS ymax FROM supplier),
corners AS (SELECT id, unnest([0, 1, 2, 3]) AS i, xmin, xmax, ymin, ymax FROM box),
sides AS (SELECT id, i, CASE WHEN i IN (0, 3) THEN xmin ELSE xmax END AS ax, CASE WHEN i IN (0, 1) THEN ymin ELSE ymax END AS ay,
  CASE WHEN i IN (0, 1) THEN xmax ELSE xmin END AS bx, CASE WHEN i IN (0, 3) THEN ymin ELSE ymax END AS by_ FROM corners),
counted AS (SELECT *, greatest(CAST(ceil(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 5000) AS INTEGER), 1) AS n FROM sides),
points AS (SELECT id, i, j, ax + (bx - ax) * j / n AS x, ay + (by_ - ay) * j / n AS y FROM (SELECT *, unnest(range(n)) AS j FROM counted))"""
_MOVED = f"WITH {_CORNERS}, {degrees_sql('points', 'd', 'x', 'y', '32')}, {plane_sql('d', 'm', '33')}"


def supplier_boxes(spark, sf_dir):
    """id and the closed ring of a box in zone 32."""
    x = F.lit(250000.0) + F.col("s_nationkey") * 24000.0
    y = F.lit(5000000.0) + F.col("s_acctbal") * 60.0
    wide = F.lit(3000.0) + F.col("s_suppkey") % 7 * 1000
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(x, y), p(x + wide, y), p(x + wide, y + 40000.0), p(x, y + 40000.0), p(x, y))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ring.alias("ring"))


def _moved(spark, sf_dir):
    return supplier_boxes(spark, sf_dir).select("id", P.reprojected(F.col("ring"), F.lit(32), F.lit(33), 5000.0).alias("ring"))


@query(f"""{_MOVED}, edges AS (SELECT id, east AS x1, north AS y1, coalesce(lead(east) OVER w, first_value(east) OVER w) AS x2, coalesce(lead(north) OVER w, first_value(north) OVER w) AS y2
  FROM m WINDOW w AS (PARTITION BY id ORDER BY i, j))
SELECT id, round(abs(sum((x1 - 250000) * (y2 - 5000000) - (x2 - 250000) * (y1 - 5000000))) / 2000000, 4) AS km2, count(*) AS points FROM edges GROUP BY id""")
def reprojected_area(spark, sf_dir):
    """Areas of boxes after a change of zone, with edges made denser first."""
    near = F.transform("ring", lambda p: F.struct((p["x"] - 250000.0).alias("x"), (p["y"] - 5000000.0).alias("y")))
    return _moved(spark, sf_dir).select("id", F.round(Y.area(near) / 1e6, 4).alias("km2"), (F.size("ring") - 1).cast("long").alias("points"))


@query(f"""{_MOVED}, moved AS (SELECT id, min(east) AS xmin, max(east) AS xmax, min(north) AS ymin, max(north) AS ymax FROM m GROUP BY id),
one AS (SELECT 250000 AS xmin, 450000 AS xmax, 5100000 AS ymin, 5400000 AS ymax)
SELECT id, round(moved.xmin, 5) AS xmin, round(moved.xmax, 5) AS xmax, round(moved.ymin, 5) AS ymin, round(moved.ymax, 5) AS ymax FROM moved, one
WHERE greatest(moved.xmin, one.xmin) < least(moved.xmax, one.xmax) AND greatest(moved.ymin, one.ymin) < least(moved.ymax, one.ymax)""")
def boxes_across_zones(spark, sf_dir):
    """Boxes of one zone that overlap an image's box in another one, compared in the image's zone."""
    names = ("xmin", "xmax", "ymin", "ymax")
    boxes = Y.extent(_moved(spark, sf_dir), ["id"])
    image = dict(zip(names, map(F.lit, (250000.0, 450000.0, 5100000.0, 5400000.0))))
    found = boxes.where(bbox_overlaps({n: F.col(n) for n in names}, image))
    return found.select("id", *[F.round(n, 5).alias(n) for n in names])


@query(f"""WITH {LAYER}, cells AS (SELECT CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c, 238000 + (b + 0.5) * 8000.0::DOUBLE AS x, 5620000 - (a + 0.5) * 8000.0::DOUBLE AS y
  FROM range(48) t(a), range(48) u(b)), {degrees_sql('cells', 'd', 'x', 'y', '33')}, {plane_sql('d', 'm', '32')}
SELECT m.r, m.c, coalesce(l.cc, -1) AS v FROM m LEFT JOIN layer l ON l.r = CAST(floor((5600000 - north) / 6000 - 0.5 + 0.5) AS INTEGER) AND l.c = CAST(floor((east - 620000) / 6000 - 0.5 + 0.5) AS INTEGER)""")
def align_across_zones(spark, sf_dir):
    """A raster of one zone on the grid of another one."""
    src = layer(spark, sf_dir).select("r", "c", F.col("cc").alias("v"))
    of = {"ulx": 620000.0, "uly": 5600000.0, "xres": 6000.0, "yres": -6000.0}
    to = {"ulx": 238000.0, "uly": 5620000.0, "xres": 8000.0, "yres": -8000.0}
    back = lambda x, y: P.change_zone(x, y, F.lit(33), F.lit(32))
    return G.align(src, of, to, 48, 48, change=back).select("r", "c", F.coalesce("v", F.lit(-1)).alias("v"))
