"""Exact overlay of pairs of polygons, convex or not.

All edges of a pair are cut by the heights of their vertices and crossings into
slabs in which no two edges meet. In a slab the edges stand side by side, and how
many of each polygon stand to the left says which of the trapezoids between them
belong to both polygons, to either, or to the first alone.

overlay_areas() takes the polygons of a group, each with all others. Polygons that
are the same ring share a class, two classes are overlaid once for both directions,
and the areas go to the pairs of their members at the end, so that only rows of the
result are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.sources.scratch import stored

#: Slabs that are lower are rounding.
LEAST_HEIGHT = 1e-9
#: Ids of a class that a row holds, about.
MEMBERS = 1024
_HELD = {"both": lambda a, b: a & b, "either": lambda a, b: a | b, "first": lambda a, b: a & ~b}
_PAIR = ["id_a", "id_b"]


def _edges(pairs: DataFrame) -> DataFrame:
    """The edges that are not level, from below upwards: id_a, id_b, second (of the second ring), x1, y1, x2, y2."""

    def of(ring: str) -> Column:
        return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    sides = pairs.select(*_PAIR, F.posexplode(F.array(of("ring_a"), of("ring_b"))).alias("side", "ends"))
    rows = sides.select(*_PAIR, (F.col("side") == 1).alias("second"), F.explode("ends").alias("e")).where("e.p.y <> e.q.y")
    up = F.col("e.p.y") < F.col("e.q.y")
    low, high = F.when(up, F.col("e.p")).otherwise(F.col("e.q")), F.when(up, F.col("e.q")).otherwise(F.col("e.p"))
    return rows.select(*_PAIR, "second", low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"))


def _at(y: Column) -> Column:
    """x of an edge at a height."""
    return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))


def _crossings(edges: DataFrame, block: float) -> DataFrame:
    """Heights at which an edge of the first ring crosses one of the second; they meet on blocks of height."""
    rows = F.explode(F.sequence(F.floor(F.col("y1") / block), F.floor(F.col("y2") / block))).alias("_block")
    a = edges.where("NOT second").select(*_PAIR, rows, *[F.col(k).alias(f"a_{k}") for k in ("x1", "y1", "x2", "y2")])
    b = edges.where("second").select(*_PAIR, rows, "x1", "y1", "x2", "y2")
    met = a.join(b, [*_PAIR, "_block"])
    ax, ay, bx, by = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cross = ax * by - ay * bx
    t = F.try_divide((F.col("x1") - F.col("a_x1")) * by - (F.col("y1") - F.col("a_y1")) * bx, cross)
    u = F.try_divide((F.col("x1") - F.col("a_x1")) * ay - (F.col("y1") - F.col("a_y1")) * ax, cross)
    return met.where(t.between(0, 1) & u.between(0, 1)).select(*_PAIR, (F.col("a_y1") + t * ay).alias("y"))


def _trapezoids(pairs: DataFrame, block: float) -> DataFrame:
    """All trapezoids of overlay(), with in_a and in_b: whether the first and the second ring hold them."""
    edges = _edges(pairs)
    heights = edges.select(*_PAIR, F.explode(F.array("y1", "y2")).alias("y")).unionByName(_crossings(edges, block))
    # equal heights make slabs without height, which go like other low ones
    slabs = heights.withColumn("y1", F.lead("y").over(Window.partitionBy(*_PAIR).orderBy("y"))).select(*_PAIR, F.col("y").alias("s0"), F.col("y1").alias("s1"))
    slabs = slabs.where(F.col("s1") - F.col("s0") > LEAST_HEIGHT)
    middle = (F.col("s0") + F.col("s1")) / 2
    beside = edges.join(slabs, _PAIR).where((F.col("y1") < middle) & (F.col("y2") > middle))
    beside = beside.select(*_PAIR, "s0", "s1", "second", _at(F.col("s0")).alias("x0"), _at(F.col("s1")).alias("x1"))
    order = Window.partitionBy(*_PAIR, "s0").orderBy(F.col("x0") + F.col("x1"), "x0", "second")
    left = order.rowsBetween(Window.unboundedPreceding, 0)
    odd = lambda second: F.sum(F.when(F.col("second") == second, 1).otherwise(0)).over(left) % 2 == 1
    told = beside.withColumns({"in_a": odd(False), "in_b": odd(True), "_x0": F.lead("x0").over(order), "_x1": F.lead("x1").over(order)})
    return told.where(F.col("_x0").isNotNull() & (F.col("_x0") + F.col("_x1") - F.col("x0") - F.col("x1") > LEAST_HEIGHT)).select(
        *_PAIR, F.col("s0").alias("y0"), F.col("s1").alias("y1"), F.col("x0").alias("left0"), F.col("x1").alias("left1"),
        F.col("_x0").alias("right0"), F.col("_x1").alias("right1"), "in_a", "in_b",
    )


def _holds(how: str, a: str = "in_a", b: str = "in_b") -> Column:
    if how not in _HELD:
        raise ValueError(f"unknown overlay: {how}")
    return _HELD[how](F.col(a), F.col(b))


def overlay(pairs: DataFrame, how: str = "both", block: float = 64.0) -> DataFrame:
    """Trapezoids of pairs (id_a, ring_a, id_b, ring_b; closed rings of x, y): id_a, id_b, y0, y1, left0, left1, right0, right1.

    how: both, either, or first (what the second lacks). left0 is the left end at
    the lower height y0, and so on. Rings may have dents and touch themselves
    (even-odd rule); empty results have no row, and pairs are told apart by ids.
    """
    return _trapezoids(pairs, block).where(_holds(how)).drop("in_a", "in_b")


def _own_area() -> Column:
    return (F.col("right0") + F.col("right1") - F.col("left0") - F.col("left1")) / 2 * (F.col("y1") - F.col("y0"))


def overlay_area(pieces: DataFrame) -> DataFrame:
    """Area and number of trapezoids of each pair of overlay()."""
    return pieces.groupBy(*_PAIR).agg(F.sum(_own_area()).alias("area"), F.count(F.lit(1)).alias("pieces"))


def _areas_both_ways(pairs: DataFrame, how: str, block: float) -> DataFrame:
    """overlay_area() of pairs and of the same pairs turned round, out of one overlay: class_a, class_b, area, pieces."""
    ahead, back = _holds(how), _holds(how, "in_b", "in_a")
    sides = _trapezoids(pairs, block).groupBy(*_PAIR).agg(
        F.sum(F.when(ahead, _own_area())).alias("area"), F.count_if(ahead).alias("pieces"), F.sum(F.when(back, _own_area())).alias("back_area"), F.count_if(back).alias("back_pieces")
    )
    way = lambda a, b, area, pieces: F.struct(F.col(a).alias("class_a"), F.col(b).alias("class_b"), F.col(area).alias("area"), F.col(pieces).alias("pieces"))
    turned = F.when(F.col("id_a") != F.col("id_b"), way("id_b", "id_a", "back_area", "back_pieces"))
    return sides.select(F.inline(F.array(way("id_a", "id_b", "area", "pieces"), turned))).where("pieces > 0")


def ring_classes(rings: DataFrame, keys: Sequence[str], id: str = "det_id") -> DataFrame:
    """The different rings of a group: keys, ring, the least and the highest id that has it (first, last), and how many do (n)."""
    return rings.groupBy(*keys, "ring").agg(F.min(id).alias("first"), F.max(id).alias("last"), F.count(F.lit(1)).alias("n"))


def member_parts(rings: DataFrame, classes: DataFrame, keys: Sequence[str], id: str = "det_id", most: int = MEMBERS) -> DataFrame:
    """The ids of each class of ring_classes(), in parts of about `most`: class, part, ids."""
    part = F.pmod(F.xxhash64(id), F.ceil(F.col("n") / most))
    own = rings.join(classes, [*keys, "ring"]).select(F.col("first").alias("class"), part.alias("part"), F.col(id).alias("id"))
    return own.groupBy("class", "part").agg(F.collect_list("id").alias("ids"))


def overlay_areas(
    rings: DataFrame, how: str = "both", keys: Sequence[str] = ("nation",), id: str = "det_id", block: float = 64.0, digits: int | None = None, most: int = MEMBERS
) -> DataFrame:
    """overlay_area() of overlay() for all pairs of rings (keys, id, ring) of equal keys: id_a < id_b, area, pieces.

    A class is named by its least id (ids are unique). Two classes are overlaid
    once, and a class with itself where it has two members; areas are of both
    directions, as the first ring may hold what the second lacks. digits: areas
    are rounded, once for each direction of a pair of classes.
    """
    classes = stored(ring_classes(rings, keys, id), "ring-classes")
    parts = member_parts(rings, classes, keys, id, most)
    a = classes.select(*keys, F.col("first").alias("id_a"), F.col("ring").alias("ring_a"))
    b = classes.select(*keys, F.col("first").alias("id_b"), F.col("ring").alias("ring_b"), "last")
    pairs = a.join(b, list(keys)).where("id_a < id_b OR (id_a = id_b AND id_a < last)").select("id_a", "ring_a", "id_b", "ring_b")
    areas = _areas_both_ways(pairs, how, block)
    if digits is not None:
        areas = areas.withColumn("area", F.round("area", digits))
    of = lambda side: parts.select(*[F.col(k).alias(f"{k}_{side}") for k in parts.columns])
    met = areas.join(of("a"), "class_a").join(of("b"), "class_b").where(F.array_min("ids_a") < F.array_max("ids_b"))
    # a row becomes up to most * most rows, and small stages would be few tasks
    met = met.repartition(4 * rings.sparkSession.sparkContext.defaultParallelism, "class_a", "part_a", "class_b", "part_b")
    firsts = met.select(F.explode("ids_a").alias("id_a"), "ids_b", "area", "pieces")
    return firsts.select("id_a", F.explode("ids_b").alias("id_b"), "area", "pieces").where("id_a < id_b")
