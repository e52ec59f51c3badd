"""Rasters, stacks and scenes made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, LAYERS = 64, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A displacement stack: r, c, k (layer), ew, ns, cc (byte)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_orderkey") % SIDE).cast("int").alias("r"),
            (F.col("l_partkey") % SIDE).cast("int").alias("c"),
            F.col("l_linenumber").alias("k"),
        )
        .agg(
            F.round(F.sum(F.col("l_discount") * 100) - 5 * F.count(F.lit(1))).cast("int").alias("ew"),
            F.round(F.sum(F.col("l_tax") * 100) - 4 * F.count(F.lit(1))).cast("int").alias("ns"),
            (F.round(F.sum("l_quantity")).cast("int") % 256).alias("cc"),
        )
    )


GRID = """grid AS (
  SELECT CAST(l_orderkey % 64 AS INTEGER) AS r, CAST(l_partkey % 64 AS INTEGER) AS c, l_linenumber AS k,
         CAST(round(sum(l_discount * 100) - 5 * count(*)) AS INTEGER) AS ew,
         CAST(round(sum(l_tax * 100) - 4 * count(*)) AS INTEGER) AS ns,
         CAST(round(sum(l_quantity)) AS INTEGER) % 256 AS cc
  FROM lineitem GROUP BY ALL
)"""


def layer(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """One layer of the grid: r, c, ew, ns, cc."""
    return grid(spark, sf_dir).where(F.col("k") == k).drop("k")


LAYER = GRID + ", layer AS (SELECT r, c, ew, ns, cc FROM grid WHERE k = 1)"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition dates: date and scene_id."""
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.select("date", F.date_format("date", "'S'yyyyMMdd").alias("scene_id"))


SCENES = "scenes AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'S' || strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS scene_id FROM orders)"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class raster with classes 0 to 5: r, c, cls (the largest of a cell)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("r"), (F.col("l_partkey") % SIDE).cast("int").alias("c"))
        .agg((F.max("p_size") % 6).alias("cls"))
    )


CLASSES = """classes AS (
  SELECT CAST(l_orderkey % 64 AS INTEGER) AS r, CAST(l_partkey % 64 AS INTEGER) AS c, max(p_size) % 6 AS cls
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 by 8 pixels: tile, r, c, v."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("pos", "v")
    ).select("tile", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), F.round(F.col("v").cast("double"), 4).alias("v"))


TILES = """tiles AS (
  SELECT vec_id AS tile, CAST((p - 1) // 8 AS INTEGER) AS r, CAST((p - 1) % 8 AS INTEGER) AS c, round(CAST(embedding[p] AS DOUBLE), 4) AS v
  FROM embeddings, unnest(range(1, 65)) AS t(p)
)"""

#: Detector footprints over the 64 by 64 grid, as closed rings.
RINGS = {
    1: [(0, 0), (24, 0), (20, 63), (0, 63), (0, 0)],
    2: [(22, 0), (44, 0), (40, 63), (18, 63), (22, 0)],
    3: [(42, 0), (63, 0), (63, 63), (38, 63), (42, 0)],
}


def rings(spark: SparkSession) -> DataFrame:
    """det_id and ring, an array of points x, y."""
    return spark.createDataFrame(
        [(k, [(float(x), float(y)) for x, y in ring]) for k, ring in RINGS.items()], "det_id int, ring array<struct<x:double,y:double>>"
    )


EDGES = "edges(det_id, i, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"({k}, {i}, {a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for k, ring in RINGS.items() for i, (a, b) in enumerate(zip(ring, ring[1:]))
) + ")"


#: Footprints of suppliers: corners of a convex ring, of one with a dent, and of a strip beside the others of its nation.
_SHAPES = {
    "convex": [("x", "y"), ("x + 3 + s % 7", "y + s % 3"), ("x + 2 + s % 5", "y + 8 + s % 4"), ("x - s % 2", "y + 6")],
    "dented": [("x", "y"), ("x + 8", "y + 2"), ("x + 3", "y + 3 + s % 3"), ("x + 6", "y + 9"), ("x - 1", "y + 5")],
    "strip": [("20 * i + s % 3", "0"), ("20 * i + 24 + s % 5", "0"), ("20 * i + 22 + s % 5", "63"), ("20 * i - s % 4", "63")],
}
_PLACED = """SELECT s_suppkey AS s, s_nationkey AS nation, s_nationkey * 2 AS x, s_suppkey % 17 AS y,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier"""


def supplier_rings(spark: SparkSession, sf_dir: str, shape: str = "convex") -> DataFrame:
    """det_id (the supplier), nation and ring, closed."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_ring_suppliers")
    placed = spark.sql(_PLACED.replace("FROM supplier", "FROM _ring_suppliers"))
    corners = [F.struct(F.expr(a).cast("double").alias("x"), F.expr(b).cast("double").alias("y")) for a, b in _SHAPES[shape]]
    return placed.select(F.col("s").cast("int").alias("det_id"), F.col("nation").cast("int").alias("nation"), F.array(*corners, corners[0]).alias("ring"))


def supplier_edges(shape: str = "convex", name: str = "edges") -> str:
    """The edges of supplier_rings() in SQL."""
    corners = _SHAPES[shape]
    sides = " UNION ALL ".join(
        f"SELECT s AS det_id, nation, {i} AS i, CAST({a[0]} AS DOUBLE) AS x1, CAST({a[1]} AS DOUBLE) AS y1, CAST({b[0]} AS DOUBLE) AS x2, CAST({b[1]} AS DOUBLE) AS y2 FROM placed"
        for i, (a, b) in enumerate(zip(corners, [*corners[1:], corners[0]]))
    )
    return f"{name} AS (WITH placed AS ({_PLACED}) {sides})"
