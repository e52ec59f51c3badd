"""Smaller operators and compositions that complete the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.operators import geometry as Y
from orthoflow.operators import gridding as G
from orthoflow.operators import masks, windows
from orthoflow.operators.statistics import gaussian_clip, outlier_mask
from orthoflow.plans.correction import zone_sql
from orthoflow.plans.fixtures import CLASSES, EDGES, GRID, LAYER, LAYERS, SIDE, classes, grid, layer, rings, supplier_edges, supplier_rings, table
from orthoflow.plans.gridded import CANVAS
from orthoflow.plans.measured import clip_sql
from orthoflow.plans.registry import query
from orthoflow.plans.stacks import BOXES, P
from orthoflow.sources import scenes as S
from orthoflow.sources.scratch import stored

_COHERENCE = """CASE WHEN sqrt((ew / nullif(7 - na, 0)) ** 2 + (ns / nullif(7 - na, 0)) ** 2) > 0.15 AND na <= 7 * 0.6
  AND NOT bna > 25 * 7 * 0.4 THEN sqrt(bew * bew + bns * bns) / nullif(bpath, 0) ELSE 0 END"""


@query(BOXES + f""", speed AS (SELECT r, c, sum(ew / CAST(k AS DOUBLE)) / nullif(7 - sum(na), 0) AS vew, sum(ns / CAST(k AS DOUBLE)) / nullif(7 - sum(na), 0) AS vns FROM marked GROUP BY r, c)
SELECT r, c, round({_COHERENCE}, 6) AS vc, round(sqrt((ew / nullif(7 - na, 0)) ** 2 + (ns / nullif(7 - na, 0)) ** 2), 6) AS mean_magn, CAST(na AS BIGINT) AS na,
round(vew, 6) AS veloc_ew, round(vns, 6) AS veloc_ns FROM boxes LEFT JOIN speed USING (r, c)""")
def stack_products(spark, sf_dir):
    out = windows.stack_products(grid(spark, sf_dir), P, LAYERS, SIDE, SIDE, "k")
    return out.select("r", "c", F.round("vc", 6).alias("vc"), F.round("mean_magn", 6).alias("mean_magn"), F.col("na").cast("long").alias("na"), F.round("veloc_ew", 6).alias("veloc_ew"), F.round("veloc_ns", 6).alias("veloc_ns"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'B01,B02,B03,B04,B05,B06,B07,B08,B8A,B09,B10,B11,B12' ELSE 'B04,B08,B8A,B09' END AS bands FROM part""")
def band_order(spark, sf_dir):
    paths = lambda names: F.array(*[F.lit(f"{b}.jp2") for b in sorted(names, reverse=True)])
    some = F.when(F.col("p_size") % 2 == 0, paths(S.S2_BANDS)).otherwise(paths(["B8A", "B04", "B08", "B09"]))
    names = F.filter(F.transform(S.order_bands(some), lambda p: F.substring(p, 1, 3)), lambda p: p.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("bands"))


@query(f"WITH {supplier_edges()} SELECT det_id, min(x1) AS xmin, max(x1) AS xmax, min(y1) AS ymin, max(y1) AS ymax FROM edges GROUP BY det_id")
def scene_extent(spark, sf_dir):
    return Y.extent(supplier_rings(spark, sf_dir), ["det_id"])


@query(f"WITH {supplier_edges()} SELECT det_id, CAST(i AS INTEGER) AS i, x2 - x1 AS dx, y2 - y1 AS dy FROM edges")
def segment_deltas(spark, sf_dir):
    return Y.edges(supplier_rings(spark, sf_dir)).select("det_id", "i", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))


@query(f"WITH {supplier_edges()} SELECT det_id, arg_min(y1, x1 * 1000 + y1) AS y_left, arg_max(y1, x1 * 1000 - y1) AS y_right FROM edges GROUP BY det_id")
def extreme_vertices(spark, sf_dir):
    """Height of the leftmost (lowest of equals) and rightmost (lowest of equals) vertex."""
    x, y = F.col("x1"), F.col("y1")
    return Y.edges(supplier_rings(spark, sf_dir)).groupBy("det_id").agg(F.min_by(y, x * 1000 + y).alias("y_left"), F.max_by(y, x * 1000 - y).alias("y_right"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'grid10' WHEN 1 THEN 'grid20' ELSE 'grid60' END AS grid FROM part""")
def resolution_lookup(spark, sf_dir):
    res = F.when(F.col("p_size") % 3 == 0, 10.0).when(F.col("p_size") % 3 == 1, 20.0).otherwise(60.0)
    bands = table(spark, sf_dir, "part").select("p_partkey", res.alias("xres"), (-res).alias("yres"))
    grids = spark.createDataFrame([(10, "grid10"), (20, "grid20"), (60, "grid60")], "res int, grid string")
    return G.grids_by_resolution(bands, grids).select("p_partkey", "grid")


@query("SELECT p_partkey FROM part WHERE p_size > 20 INTERSECT SELECT p_partkey FROM part WHERE p_size < 40")
def set_intersection(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 20").select("p_partkey").intersect(p.where("p_size < 40").select("p_partkey"))


@query("SELECT p_partkey FROM part WHERE p_size > 20 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark, sf_dir):
    parts, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return parts.where("p_size > 20").select("p_partkey").subtract(items.where("l_quantity > 40").select("l_partkey"))


@query(f"WITH {GRID} SELECT k, r // 16 AS block_r, c // 16 AS block_c, count(*) AS cells, count(*) FILTER (ew <> 0) AS moved FROM grid GROUP BY ALL")
def block_counts(spark, sf_dir):
    at = lambda n: F.floor(F.col(n) / 16).cast("int")
    return grid(spark, sf_dir).groupBy("k", at("r").alias("block_r"), at("c").alias("block_c")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("ew") != 0).alias("moved")
    )


@query(f"WITH {CLASSES} SELECT DISTINCT cls FROM classes")
def distinct_classes(spark, sf_dir):
    return classes(spark, sf_dir).select("cls").distinct()


@query(f"""WITH RECURSIVE {GRID}, s AS MATERIALIZED (SELECT ew AS v FROM grid), {clip_sql("g", "s")}
SELECT r, c, k, CASE WHEN ew > mu - 2.575 * sg AND ew < mu + 2.575 * sg THEN CAST(ew AS DOUBLE) END AS ew FROM grid, g""")
def input_outlier_mask(spark, sf_dir):
    g = stored(grid(spark, sf_dir), "grid")
    found = gaussian_clip(g, "ew")
    return g.select("r", "c", "k", outlier_mask(F.col("ew").cast("double"), found.sigma, found.mu).alias("ew"))


OTHER = "other AS (SELECT r, c, abs(max(ew)) % 6 AS cls FROM grid GROUP BY r, c)"


@query(f"""WITH {CLASSES}, {GRID}, {OTHER}, m0 AS (SELECT r, c, CASE WHEN a.cls NOT IN (0, 2, 4, 5) AND b.cls NOT IN (0, 2, 4, 5) THEN 255 ELSE 0 END AS v FROM classes a JOIN other b USING (r, c)),
m1 AS (SELECT a.r, a.c, max(b.v) AS v FROM m0 a JOIN m0 b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c),
m2 AS (SELECT a.r, a.c, min(b.v) AS v FROM m1 a JOIN m1 b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c)
SELECT t.r, t.c, coalesce(m2.v, -1) AS v FROM {CANVAS.format(32, 32)} t LEFT JOIN m2 ON m2.r = t.r * 2 + 1 AND m2.c = t.c * 2 + 1""")
def combined_masks_aligned(spark, sf_dir):
    """Two class rasters combined, closed, and put on a grid of half the resolution."""
    other = grid(spark, sf_dir).groupBy("r", "c").agg((F.abs(F.max("ew")) % 6).alias("cls"))
    both = masks.combine_masks(classes(spark, sf_dir), other).select("r", "c", F.col("mask").alias("v"))
    closed = windows.close_open(both, 10, None, resolution=10)
    fine, coarse = {"ulx": 0.0, "uly": 640.0, "xres": 10.0, "yres": -10.0}, {"ulx": 0.0, "uly": 640.0, "xres": 20.0, "yres": -20.0}
    return G.align(closed, fine, coarse, 32, 32).select("r", "c", F.coalesce("v", F.lit(-1)).alias("v"))


@query(f"""WITH {LAYER} SELECT t.r, t.c, l.ew / 2.0::DOUBLE AS v FROM {CANVAS.format(32, 32)} t LEFT JOIN layer l ON l.r = t.r * 2 + 1 AND l.c = t.c * 2 + 1""")
def warp_offsets(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("ew").cast("double").alias("v"))
    fine, coarse = {"ulx": 0.0, "uly": 640.0, "xres": 10.0, "yres": -10.0}, {"ulx": 0.0, "uly": 640.0, "xres": 20.0, "yres": -20.0}
    return G.warp_offsets(src, fine, coarse, 32, 32, res_ref=10.0)


@query(f"""WITH {EDGES.replace('edges(', 'all_edges(')}, {LAYER}, edges AS (SELECT * FROM all_edges WHERE det_id < 3), {zone_sql('layer', 'a')}
SELECT r, c FROM a WHERE det_id IN (1, 2) AND (r, c) IN (SELECT r, c FROM layer WHERE c >= 20)""")
def outline_intersection(spark, sf_dir):
    """Cells of the footprints of two detectors that also lie in a box."""
    box_ring = spark.createDataFrame([(9, [(20.0, 0.0), (63.0, 0.0), (63.0, 63.0), (20.0, 63.0), (20.0, 0.0)])], "det_id int, ring array<struct<x:double,y:double>>")
    return Y.outline_intersection(layer(spark, sf_dir).select("r", "c"), rings(spark).where("det_id < 3"), box_ring)


@query(f"""WITH {supplier_edges()} SELECT det_id, 'POLYGON ((' || string_agg(x1 || ' ' || y1, ', ' ORDER BY i) || ', ' || arg_min(x1 || ' ' || y1, i) || '))' AS wkt FROM edges GROUP BY det_id""")
def ring_text(spark, sf_dir):
    """Rings as text, after text was read as rings."""
    again = supplier_rings(spark, sf_dir).select("det_id", S.ring_of_wkt(R.wkt(F.col("ring"))).alias("ring"))
    return again.select("det_id", R.wkt(F.col("ring")).alias("wkt"))


@query(f"""WITH {supplier_edges("strip")}, ends AS (SELECT nation, det_id, y1 AS y, min(x1) AS x0, max(x1) AS x1 FROM edges GROUP BY nation, det_id, y1),
middle AS (SELECT nation, det_id, y, coalesce((lag(x1) OVER w + x0) / 2, x0) AS x0, coalesce((x1 + lead(x0) OVER w) / 2, x1) AS x1 FROM ends WINDOW w AS (PARTITION BY nation, y ORDER BY det_id))
SELECT 'g' || nation AS granule, det_id, round(sum(x1 - x0) / 2 * 63, 6) AS area FROM middle GROUP BY nation, det_id""")
def footprint_mid_lines(spark, sf_dir):
    """Overlapping footprints of each nation made to abut."""
    name = F.concat(F.lit("g"), F.col("nation").cast("string"))
    old = supplier_rings(spark, sf_dir, "strip").select(name.alias("granule"), F.lit("2017-01-01").cast("date").alias("sensed"), "det_id", "ring")
    return Y.resolve_footprints(old).select("granule", "det_id", F.round(Y.area(F.col("ring")), 6).alias("area"))


@query(f"""WITH {supplier_edges()} SELECT det_id, CAST(row_number() OVER (PARTITION BY det_id ORDER BY y1 + y2, x1 + x2) - 1 AS INTEGER) AS i, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM edges""")
def sorted_mid_points(spark, sf_dir):
    """The middles of the footprints' edges by height."""
    return supplier_rings(spark, sf_dir).select("det_id", F.posexplode(Y.mid_points(F.col("ring"))).alias("i", "p")).select("det_id", "i", "p.x", "p.y")
