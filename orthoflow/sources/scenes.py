"""Scene metadata, folder listings and footprints as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.functions.raster import two_dates

#: The bands of a Sentinel-2 granule in order; B8A stands behind B08.
S2_BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12"]


def satellite(name: Column) -> Column:
    """L8 for Landsat metadata files, S2 for Sentinel-2 names; other names are an error."""
    return (
        F.when(name.rlike(r"MTL\.txt$"), "L8")
        .when(name.rlike("^(S2|L1C)"), "S2")
        .otherwise(F.raise_error(F.concat(F.lit("unknown satellite: "), name)))
    )


def landsat_scenes(lines: DataFrame) -> DataFrame:
    """Scenes from the lines (path, value) of Landsat metadata texts.

    path, date, time, band_paths (file names but that of BQA, sorted), match_band (the eighth).
    """
    pair = lines.select(
        "path",
        F.trim(F.regexp_extract("value", r"^\s*(\w+)\s*=", 1)).alias("name"),
        F.regexp_extract("value", r'=\s*"?([^"]*)"?\s*$', 1).alias("text"),
    )
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("text")))
    bands = F.collect_set(F.when(F.col("name").startswith("FILE_NAME_BAND") & ~F.col("text").endswith("BQA.TIF"), F.col("text")))
    found = pair.groupBy("path").agg(
        F.to_date(pick("DATE_ACQUIRED")).alias("date"), pick("SCENE_CENTER_TIME").alias("time"), F.array_sort(bands).alias("band_paths")
    )
    return found.withColumn("match_band", F.get("band_paths", F.lit(7)))


def sentinel_scenes(texts: DataFrame) -> DataFrame:
    """Scenes from Sentinel-2 metadata (path, xml): path, date, time (whole, behind the T)."""
    when = F.xpath_string("xml", F.lit("//*[local-name()='PRODUCT_START_TIME']"))
    return texts.select("path", F.to_date(F.substring(when, 1, 10)).alias("date"), F.expr("substring(xpath_string(xml, \"//*[local-name()='PRODUCT_START_TIME']\"), 12)").alias("time"))


def order_bands(paths: Column) -> Column:
    """Band paths in the order of S2_BANDS."""
    order = F.array(*map(F.lit, S2_BANDS))
    return F.transform(order, lambda b: F.get(F.filter(paths, lambda p: F.contains(p, b)), F.lit(0)))


def select_bands(paths: Column, parts: list[str]) -> Column:
    """Paths that hold one of the parts."""
    wanted = F.array(*map(F.lit, parts))
    return F.filter(paths, lambda p: F.exists(wanted, lambda w: F.contains(p, w)))


def granules(files: DataFrame) -> DataFrame:
    """Folders of scenes that hold the files (path): those whose names end in SAFE or start with LC8, and how many files lie in each."""
    name = F.regexp_extract("path", r"/((?:[^/]*SAFE)|(?:LC8[^/]*))/(?:[^/]*)$", 1)
    return files.select(name.alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def scene_folders(spark: SparkSession, root: str) -> DataFrame:
    """granules() below root, by Spark's file listing."""
    return granules(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")).select("folder")


def first_match(files: DataFrame, key: str, pattern: str) -> DataFrame:
    """key and the smallest path whose file name matches a regular expression as a whole; keys without one have no row."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(name.rlike(f"^(?:{pattern})$")).groupBy(key).agg(F.min("path").alias("path"))


def path_parts(path: Column) -> Column:
    """folder, base, stem and extension (with its dot, empty without one) of a path; a leading dot starts no extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.struct(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), base.alias("base"),
        F.regexp_extract(base, r"^(.+?)(?:\.[^.]*)?$", 1).alias("stem"), F.regexp_extract(base, r"^.+(\.[^.]*)$", 1).alias("extension"),
    )


def layers(files: DataFrame, only_multitemporal: bool = True, most: int | None = None) -> DataFrame:
    """Displacement layers from file paths: folder, date1, date2, duration_days, px1, px2, cc.

    A folder's name must hold two dates; files are told apart by the start of
    their names, and only folders with all three count. `most` keeps the first
    folders by name. The duration comes from the two dates.
    """
    parts = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path"
    ).where(F.col("file").rlike(r"\.tif"))
    pick = lambda start: F.min(F.when(F.col("file").startswith(start), F.col("path")))
    found = parts.groupBy("folder").agg(pick("Px1").alias("px1"), pick("Px2").alias("px2"), pick("Correl").alias("cc"))
    found = found.withColumn("d", two_dates(F.col("folder"))).where("d is not null and px1 is not null and px2 is not null and cc is not null")
    out = found.select(
        "folder", F.col("d.date1").alias("date1"), F.col("d.date2").alias("date2"),
        F.datediff("d.date2", "d.date1").alias("duration_days"), "px1", "px2", "cc",
    )
    if only_multitemporal:
        out = out.where("date1 <> date2")
    return out if most is None else out.orderBy("folder").limit(most)


def complete(files: DataFrame, key: str, kind: str, wanted: int = 3) -> DataFrame:
    """Keys that have that many different kinds of output, at least."""
    return files.groupBy(key).agg(F.count_distinct(kind).alias("kinds")).where(F.col("kinds") >= wanted)


def sensing_date(gml_id: Column) -> Column:
    """The date in a footprint's id: eight digits at the start of the fifth part from the end."""
    return F.to_date(F.substring(F.element_at(F.split(gml_id, "_"), -5), 1, 8), "yyyyMMdd")


def ring_of(coordinates: Column, dimension: int = 3) -> Column:
    """A ring of points x, y from a list of coordinates; what is beyond x and y is dropped."""
    numbers = F.transform(F.split(F.trim(coordinates), r"\s+"), lambda x: x.cast("double"))
    at = F.sequence(F.lit(0), F.floor(F.size(numbers) / dimension).cast("int") - 1)
    return F.transform(at, lambda i: F.struct(F.get(numbers, i * dimension).alias("x"), F.get(numbers, i * dimension + 1).alias("y")))


def listed_layers(lists: DataFrame) -> DataFrame:
    """Layers from lists of arguments in fours (id, arguments): id, layer, px1, px2, cc and the duration in days."""
    whole = F.when(F.size("arguments") % 4 == 0, F.col("arguments")).otherwise(F.raise_error(F.lit("a layer has four arguments")).cast("array<string>"))
    each = lists.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("arguments"), F.lit(4)), lambda i: F.slice(whole, i, F.lit(4)))).alias("layer", "a"))
    part = lambda k: F.get("a", F.lit(k))
    return each.select("id", "layer", part(0).alias("px1"), part(1).alias("px2"), part(2).alias("cc"), part(3).cast("double").alias("duration_days"))


def ring_of_wkt(text: Column) -> Column:
    """The outer ring of a polygon's well-known text."""
    inner = F.regexp_extract(text, r"\(\(\s*([^()]*)\)", 1)
    points = F.split(F.trim(inner), r"\s*,\s*")
    number = lambda p, i: F.get(F.split(p, r"\s+"), F.lit(i)).cast("double")
    return F.transform(points, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))


def footprints_of_gml(texts: DataFrame, dimension: int = 3) -> DataFrame:
    """Detector footprints of mask texts (path, xml): path, gml_id, det_id, sensed, ring, and orbit order `i` within the text.

    Features and their coordinate lists are met by their order; z is dropped. The
    detector is the number in the third part of the id from the end.
    """
    ids = F.expr("xpath(xml, \"//*[local-name()='MaskFeature']/@*[local-name()='id']\")")
    lists = F.expr("xpath(xml, \"//*[local-name()='posList']/text()\")")
    each = texts.select("path", F.posexplode(F.arrays_zip(ids.alias("gml_id"), lists.alias("positions"))).alias("i", "f"))
    part = F.element_at(F.split("f.gml_id", "-"), -3)
    return each.select(
        "path", "i", F.col("f.gml_id").alias("gml_id"), F.regexp_extract(part, r"(\d+)$", 1).cast("int").alias("det_id"),
        sensing_date(F.col("path")).alias("sensed"), ring_of(F.col("f.positions"), dimension).alias("ring"),
    )
