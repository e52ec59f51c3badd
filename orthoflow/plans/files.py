"""Rasters and metadata that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orthoflow.operators import windows as W
from orthoflow.plans.fixtures import GRID, SIDE, grid, table
from orthoflow.plans.registry import query
from orthoflow.sources import rasters as X
from orthoflow.sources import scenes as S
from orthoflow.sources.scratch import shared_dir

CELLS = f"{GRID}, cells AS (SELECT k, CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c FROM (SELECT DISTINCT k FROM grid), range(64) t(a), range(64) u(b))"
PLACE = (300000.0, 10.0, 0.0, 4900020.0, 0.0, -10.0)


def band_files(spark, sf_dir, compress):
    """A TIFF file for each layer of the grid: path, content."""
    cells = grid(spark, sf_dir).select("k", "r", "c", F.col("ew").alias("v"))
    return X.as_tiff(cells, SIDE, SIDE, "k", "int16", PLACE, compress).select(F.concat(F.lit("/t/"), "k", F.lit(".tif")).alias("path"), "content")


def _layer(pixels):
    return pixels.select(F.regexp_extract("path", r"/(\d+)\.tif$", 1).cast("int").alias("k"), "r", "c", "v")


@query(f"WITH {CELLS} SELECT k, r, c, CAST(coalesce(ew, 0) AS DOUBLE) AS v FROM cells LEFT JOIN grid USING (k, r, c)")
def band_files_read(spark, sf_dir):
    """Whole bands written as plain TIFF files and read back; masked cells are 0."""
    return _layer(X.read_tiff(band_files(spark, sf_dir, False)))


@query(f"WITH {CELLS} SELECT k, r, c, CAST(coalesce(ew, 0) AS DOUBLE) AS v FROM cells LEFT JOIN grid USING (k, r, c) WHERE r BETWEEN 10 AND 40 AND c BETWEEN 50 AND 63")
def band_window_read(spark, sf_dir):
    """A window of bands that were written as deflated TIFF files; it reaches beyond the image."""
    return _layer(X.read_tiff(band_files(spark, sf_dir, True), (10, 40, 50, 90)))


@query(f"""WITH {GRID} SELECT DISTINCT '/t/' || k || '.tif' AS path, CAST(64 AS INTEGER) AS rows, CAST(64 AS INTEGER) AS cols, false AS tiled,
300000.0::DOUBLE AS ulx, 10.0::DOUBLE AS xres, 4900020.0::DOUBLE AS uly, -10.0::DOUBLE AS yres FROM grid""")
def band_information(spark, sf_dir):
    """Sizes and places of written files."""
    at = lambda i: F.get("geotransform", F.lit(i))
    info = X.tiff_info(band_files(spark, sf_dir, False))
    return info.select("path", "rows", "cols", "tiled", at(0).alias("ulx"), at(1).alias("xres"), at(3).alias("uly"), at(5).alias("yres"))


@query("""SELECT 'r' || s_suppkey AS raster, 'n' || s_nationkey AS ref, n_nationkey * 10.0::DOUBLE AS ulx, 'EPSG:' || (32600 + n_regionkey) AS srs_wkt
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20""")
def georeferenced(spark, sf_dir):
    """Rasters with the place and projection of their reference; those without one have none."""
    own = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), "s_suppkey").alias("raster"), F.concat(F.lit("n"), "s_nationkey").alias("ref"),
        F.array(F.lit(1.0)).alias("geotransform"), F.lit("old").alias("srs_wkt"),
    )
    ref = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(
        F.concat(F.lit("n"), "n_nationkey").alias("raster"), F.array(F.col("n_nationkey") * F.lit(10.0)).alias("geotransform"),
        F.concat(F.lit("EPSG:"), (F.col("n_regionkey") + 32600).cast("string")).alias("srs_wkt"),
    )
    return X.georeference(own, ref).select("raster", "ref", F.get("geotransform", F.lit(0)).alias("ulx"), "srs_wkt")


@query(f"WITH {GRID} SELECT k, r, c, coalesce(ew, 0) AS v FROM grid WHERE r BETWEEN 5 AND 20 AND c BETWEEN 30 AND 35")
def pixel_window(spark, sf_dir):
    """A window of all layers that were written as a pixel table."""
    path = f"{shared_dir(spark)}/orthoflow/pixels-{uuid.uuid4().hex}"
    X.write_pixels(grid(spark, sf_dir).select("k", "r", "c", F.col("ew").alias("v")), path, keys=("k",))
    return X.read_pixels(spark, path, (5, 20, 30, 35))


@query(f"""WITH {GRID}, b AS (SELECT k, r, c, ew * 0.5::DOUBLE AS v, unnest(range(greatest(r - 3, 0) // 16, (r + 3) // 16 + 1)) AS block_r FROM grid),
d AS (SELECT k, r, c, v, CAST(block_r AS INTEGER) AS block_r, CAST(unnest(range(greatest(c - 3, 0) // 16, (c + 3) // 16 + 1)) AS INTEGER) AS block_c FROM b)
SELECT k, block_r, block_c, count(*) AS n, count(*) FILTER (r // 16 = block_r AND c // 16 = block_c) AS own, sum(v) AS total,
  sum((r - block_r * 16 + 3) * 100 + c - block_c * 16 + 3) AS places FROM d GROUP BY k, block_r, block_c""")
def block_reads(spark, sf_dir):
    """Blocks of 16 by 16 cells with a halo of 3, of raw layers in map units."""
    raw = grid(spark, sf_dir).select("k", "r", "c", F.col("ew").alias("v"))
    met = X.blocks(X.layer_values(raw, 10.0, 0.05), 16, 3)
    return met.groupBy("k", "block_r", "block_c").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own"), F.sum("v").alias("total"), F.sum(F.col("br") * 100 + F.col("bc")).alias("places")
    )


@query(f"WITH {GRID} SELECT k, r, c, ew FROM grid")
def partial_results(spark, sf_dir):
    """Layers cut into blocks with a halo and put together again: each cell once."""
    met = X.blocks(grid(spark, sf_dir).select("k", "r", "c", "ew"), 16, 3)
    return X.from_blocks(met.drop("r", "c", "own"), 16, 3).select("k", "r", "c", "ew")


@query("""SELECT DISTINCT 'S' || o_custkey % 500 AS path, CAST(DATE '2017-01-01' + CAST(o_custkey % 500 AS INTEGER) AS VARCHAR) AS date,
'1' || (o_custkey % 500) % 10 || ':20:30.123Z' AS time FROM orders""")
def sentinel_metadata(spark, sf_dir):
    """Metadata texts are made of customers, then parsed again."""
    key = (F.col("o_custkey") % 500).cast("int")
    day = F.date_format(F.date_add(F.lit("2017-01-01").cast("date"), key), "yyyy-MM-dd")
    xml = F.format_string("<n1:P xmlns:n1='u'><a><PRODUCT_START_TIME>%sT1%d:20:30.123Z</PRODUCT_START_TIME></a></n1:P>", day, key % 10)
    texts = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), key.cast("string")).alias("path"), xml.alias("xml")).distinct()
    return S.sentinel_scenes(texts).select("path", F.col("date").cast("string").alias("date"), "time")


@query("""SELECT 'S2A_' || p_size || '.SAFE' AS folder, count(*) AS files FROM part WHERE p_size % 3 = 0 GROUP BY p_size
UNION ALL SELECT 'LC8_' || p_size, count(*) FROM part WHERE p_size % 3 = 1 GROUP BY p_size""")
def granule_folders(spark, sf_dir):
    """Folders of scenes among the paths of files."""
    size = F.col("p_size")
    form = F.when(size % 3 == 0, "/in/S2A_%d.SAFE/%d.jp2").when(size % 3 == 1, "/in/LC8_%d/%d.TIF").otherwise("/in/other_%d/%d.TIF")
    paths = F.when(size % 3 == 0, F.format_string("/in/S2A_%d.SAFE/%d.jp2", size, "p_partkey")).when(
        size % 3 == 1, F.format_string("/in/LC8_%d/%d.TIF", size, "p_partkey")
    )
    files = table(spark, sf_dir, "part").select(F.coalesce(paths, F.concat(F.lit("/in/other/"), form)).alias("path"))
    return S.granules(files)


@query("""SELECT p_size, '/a/' || min('M' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '_B08.jp2') AS path FROM part WHERE p_partkey % 4 = 0 GROUP BY p_size""")
def first_match(spark, sf_dir):
    """The first band file of each size."""
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/a/M"), key, F.lit("_B08.jp2"))).otherwise(F.concat(F.lit("/a/B08_"), key, F.lit(".xml")))
    return S.first_match(table(spark, sf_dir, "part").select("p_size", name.alias("path")), "p_size", r".*_B08\.jp2")


@query("""SELECT p_partkey, '/a/b' || p_size AS folder, replace(p_name, ' ', '.') || '.tif' AS base, replace(p_name, ' ', '.') AS stem, '.tif' AS extension FROM part""")
def path_parts(spark, sf_dir):
    """Folder, base name, stem and extension of paths whose names have dots."""
    path = F.concat(F.lit("/a/b"), F.col("p_size").cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".tif"))
    return table(spark, sf_dir, "part").select("p_partkey", S.path_parts(path).alias("x")).select("p_partkey", "x.*")


@query("""SELECT o_custkey AS id, CAST(k AS INTEGER) AS layer, 'a' || o_custkey || k AS px1, 'b' || k AS px2, 'c' || k AS cc, CAST(o_custkey % 50 + 0.5 * k AS DOUBLE) AS duration_days
FROM (SELECT DISTINCT o_custkey FROM orders), range(3) t(k)""")
def listed_layers(spark, sf_dir):
    """Layers of lists of arguments in fours, one list for each customer."""
    key = F.col("o_custkey").cast("string")
    four = lambda k: [F.concat(F.lit("a"), key, F.lit(str(k))), F.lit(f"b{k}"), F.lit(f"c{k}"), (F.col("o_custkey") % 50 + 0.5 * k).cast("string")]
    lists = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.array(*four(0), *four(1), *four(2)).alias("arguments")).distinct()
    return S.listed_layers(lists)


@query("""SELECT p_partkey, CASE WHEN p_size < 1 OR p_size % 2 = 0 THEN 'the window must be odd' WHEN p_partkey % 3 = 2 THEN 'only_multitemporal must be 0 or 1'
WHEN p_partkey % 5 = 4 THEN 'min_matches must be in 0..1' WHEN p_partkey % 7 = 0 THEN 'either a folder or layers must be given'
WHEN p_partkey % 7 > 3 AND p_partkey % 2 = 0 THEN 'max_layers needs a folder' END AS error FROM part""")
def option_errors(spark, sf_dir):
    """What is wrong with made-up options of a run."""
    k = F.col("p_partkey")
    options = {
        "window": F.col("p_size"), "only_multitemporal": k % 3, "min_matches": (k % 5) * 0.3, "folder": F.when((k % 7 > 0) & (k % 7 <= 3), "f"),
        "layers": F.when(k % 7 > 3, 4), "max_layers": F.when(k % 2 == 0, 9),
    }
    return table(spark, sf_dir, "part").select("p_partkey", W.option_error(options).alias("error"))


@query("""SELECT DISTINCT 'GS2_' || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || 'T101112_A_B_C_D' AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sensed FROM orders""")
def sensing_dates(spark, sf_dir):
    """Dates in the ids of footprint files."""
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("GS2_"), F.date_format(F.to_date("o_orderdate"), "yyyyMMdd"), F.lit("T101112_A_B_C_D")).alias("id"))
    return ids.distinct().select("id", S.sensing_date(F.col("id")).cast("string").alias("sensed"))


@query("""SELECT 'G_' || (20170101 + s_suppkey % 28) || 'T1_A_B_C_D' AS path, s_suppkey % 28 AS supplier_day, CAST(d + 1 AS INTEGER) AS det_id, CAST(p AS INTEGER) AS point,
  CAST(d * 100 + CASE WHEN p IN (1, 2) THEN 50 ELSE 0 END AS DOUBLE) AS x, CAST(s_suppkey % 28 + CASE WHEN p IN (2, 3) THEN 10 ELSE 0 END AS DOUBLE) AS y,
  CAST(DATE '2017-01-01' + CAST(s_suppkey % 28 AS INTEGER) AS VARCHAR) AS sensed
FROM (SELECT DISTINCT s_suppkey % 28 AS s_suppkey FROM supplier), range(2) t(d), range(5) u(p)""")
def footprint_rings(spark, sf_dir):
    """Footprint texts with heights are made of suppliers, then read as rings; the id of a feature names its detector."""
    day = (F.col("s_suppkey") % 28).cast("int")
    positions = lambda d: F.format_string(f"{d * 100} %d 7 {d * 100 + 50} %d 7 {d * 100 + 50} %d 7 {d * 100} %d 7 {d * 100} %d 7", day, day, day + 10, day + 10, day)
    feature = lambda d: F.concat(
        F.lit(f"<eop:MaskFeature xmlns:eop='e' xmlns:gml='g' gml:id='detector_footprint-B03-0{d + 1}-0-x'><gml:posList>"), positions(d), F.lit("</gml:posList></eop:MaskFeature>")
    )
    path = F.format_string("G_%dT1_A_B_C_D", day + 20170101)
    texts = table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat(F.lit("<m>"), feature(0), feature(1), F.lit("</m>")).alias("xml")).distinct()
    read = S.footprints_of_gml(texts).select("path", "det_id", F.col("sensed").cast("string").alias("sensed"), F.posexplode("ring").alias("point", "p"))
    supplier_day = F.regexp_extract("path", r"_(\d+)T", 1).cast("long") - 20170101
    return read.select("path", supplier_day.alias("supplier_day"), "det_id", "point", "p.x", "p.y", "sensed")


#: Names of folders hold dates of this century, so days of orders are moved by ten years.
_LAYERS = """dated AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 3653 AS d1, CAST(o_orderdate AS DATE) + 3653 + CAST(o_custkey % 3 * 16 AS INTEGER) AS d2 FROM orders),
named AS (SELECT strftime(d1, '%Y%m%d') || '1034251_x_' || strftime(d2, '%Y%m%d') || '1030181' AS folder, d1, d2 FROM dated)"""


def _layer_files(spark, sf_dir):
    """Three outputs and a stray file for each folder; folders of odd days lack one output."""
    day = F.date_add(F.to_date("o_orderdate"), 3653)
    later = F.date_add(day, (F.col("o_custkey") % 3 * 16).cast("int"))
    text = lambda d: F.date_format(d, "yyyyMMdd")
    folder = F.concat(text(day), F.lit("1034251_x_"), text(later), F.lit("1030181"))
    names = F.array(F.lit("Px1_Num6.tif"), F.when(F.dayofmonth(day) % 2 == 0, F.lit("Px2_Num6.tif")), F.lit("Correl_Num_5.tif"), F.lit("Px1_Num6.xml"))
    rows = table(spark, sf_dir, "orders").select(folder.alias("folder"), F.explode(F.array_compact(names)).alias("name")).distinct()
    return rows.select(F.concat(F.lit("/out/"), "folder", F.lit("/"), "name").alias("path"))


@query(f"""WITH {_LAYERS} SELECT folder, CAST(d1 AS VARCHAR) AS date1, CAST(d2 AS VARCHAR) AS date2, CAST(d2 - d1 AS INTEGER) AS duration_days, '/out/' || folder || '/Px1_Num6.tif' AS px1
FROM named WHERE day(d1) % 2 = 0 AND d1 <> d2""")
def search_layers(spark, sf_dir):
    """Complete layers among the files below a folder."""
    found = S.layers(_layer_files(spark, sf_dir))
    return found.select("folder", F.col("date1").cast("string").alias("date1"), F.col("date2").cast("string").alias("date2"), "duration_days", "px1")


@query(f"WITH {_LAYERS} SELECT count(*) FILTER (d1 <> d2) AS multitemporal, count(*) AS layers FROM named WHERE day(d1) % 2 = 0")
def count_layers(spark, sf_dir):
    """How many complete layers there are, with and without those of one date."""
    found = S.layers(_layer_files(spark, sf_dir), only_multitemporal=False)
    return found.agg(F.count_if(F.col("date1") != F.col("date2")).alias("multitemporal"), F.count(F.lit(1)).alias("layers"))
