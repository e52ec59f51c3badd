"""Dense matching of two rasters by normalised cross-correlation.

Each cell of the first raster is tried with all offsets of a search square: both
rasters meet once for each offset, box sums (two one-dimensional windows) give the
correlations of all windows, and an aggregate keeps the best offset of each cell.
So cost is linear in offsets, and no task holds more than a row or a column. Over
a pyramid the search is narrow at each level: the offsets that a coarser level
found, averaged by blocks, say where the next one looks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.operators.gridding import zoom_out
from orthoflow.operators.windows import filled
from orthoflow.sources.scratch import stored

#: Share of a window's cells that both rasters must have.
COVER = 0.5


def _correlations(tried: DataFrame, radius: int, keys: Sequence[str]) -> DataFrame:
    """tried (keys, r, c, a, b; one row a cell) with cc, the correlation of the windows, null where they are too empty or flat."""
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-radius, radius)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    parts = {"_n": F.lit(1.0), "_a": F.col("a"), "_b": F.col("b"), "_aa": F.col("a") * F.col("a"), "_bb": F.col("b") * F.col("b"), "_ab": F.col("a") * F.col("b")}
    out = tried.withColumns({k: F.when(both, v).otherwise(0.0) for k, v in parts.items()})
    out = out.withColumns({k: F.sum(k).over(across) for k in parts})
    out = out.withColumns({k: F.sum(k).over(down) for k in parts})
    n, va = F.col("_n"), F.col("_n") * F.col("_aa") - F.col("_a") * F.col("_a")
    vb = n * F.col("_bb") - F.col("_b") * F.col("_b")
    full = (n > COVER * (2 * radius + 1) ** 2) & (va > 0) & (vb > 0)
    cc = (n * F.col("_ab") - F.col("_a") * F.col("_b")) / (F.sqrt(va) * F.sqrt(vb))
    return out.withColumn("cc", F.when(full & both, cc)).drop(*parts)


def _peak(low: Column, top: Column, high: Column) -> Column:
    """Place of the top of the parabola through three values, from the middle one; 0 if there is none."""
    bend = low - top * 2 + high
    return F.when((bend < 0) & (low <= top) & (high <= top), (low - high) / (bend * 2)).otherwise(0.0)


def _summit(near: dict[tuple[int, int], Column]) -> tuple[Column, Column]:
    """Place of the top of the paraboloid through nine values, from the middle one; with neighbours missing or no such top, that of each axis."""
    top = near[0, 0]
    gy, gx = (near[1, 0] - near[-1, 0]) / 2, (near[0, 1] - near[0, -1]) / 2
    yy, xx = near[-1, 0] - top * 2 + near[1, 0], near[0, -1] - top * 2 + near[0, 1]
    xy = (near[1, 1] - near[1, -1] - near[-1, 1] + near[-1, -1]) / 4
    det = yy * xx - xy * xy
    y, x = F.try_divide(xy * gx - xx * gy, det), F.try_divide(xy * gy - yy * gx, det)
    sound = F.coalesce((yy < 0) & (det > 0) & (F.abs(y) <= 1) & (F.abs(x) <= 1), F.lit(False))
    alone = lambda low, high: F.coalesce(_peak(low, top, high), F.lit(0.0))
    return F.when(sound, y).otherwise(alone(near[-1, 0], near[1, 0])), F.when(sound, x).otherwise(alone(near[0, -1], near[0, 1]))


def _best(correlated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows keys, r, c, dy, dx, cc the best offset of each cell with its sub-pixel part: keys, r, c, py, px, cc."""
    near = F.abs("dy") + F.abs("dx")
    # of equal correlations the smallest offset
    order = F.struct(F.round("cc", 9).alias("q"), (-near).alias("near"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))
    offset = F.struct("dy", "dx")
    found = correlated.where("cc IS NOT NULL").groupBy(*keys, "r", "c").agg(
        F.max_by(F.struct("dy", "dx", "cc"), order).alias("top"), F.map_from_entries(F.collect_list(F.struct(offset.alias("k"), F.col("cc").alias("v")))).alias("all")
    )
    at = lambda dy, dx: F.try_element_at("all", F.struct((F.col("top.dy") + dy).cast("int").alias("dy"), (F.col("top.dx") + dx).cast("int").alias("dx")))
    top = F.col("top.cc")
    y, x = _summit({(i, j): at(i, j) if i or j else top for i in (-1, 0, 1) for j in (-1, 0, 1)})
    py, px = F.col("top.dy") + y, F.col("top.dx") + x
    return found.select(*keys, "r", "c", py.alias("py"), px.alias("px"), top.alias("cc"))


def _whole(raster: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """The raster's box (keys, r, c, a), null where it has no cell, as a window that runs along rows and then columns needs the cells between."""
    return filled(raster.select(*keys, "r", "c", F.col(value).cast("double").alias("a")), keys).drop("_own")


def _offsets(search: int) -> Column:
    return F.explode(F.sequence(F.lit(-search), F.lit(search)))


def dense_match(first: DataFrame, second: DataFrame, search: int, radius: int, least: float = 0.0, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Offsets of the second raster against the first, by cell: keys, r, c, py, px (in cells, down and right), cc.

    The value of the first at (r, c) is found in the second at (r + py, c + px).
    search: the largest offset tried on either axis; radius: that of the window;
    least: cells whose best correlation is lower go. A correlation needs more than
    half of the window in both rasters, and the cell itself; flat windows have
    none. Offsets of equal correlation: the smallest stays.
    """
    a = _whole(first, value, keys).withColumn("dy", _offsets(search)).withColumn("dx", _offsets(search))
    b = second.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).cast("double").alias("b"))
    met = a.withColumns({"_r": F.col("r") + F.col("dy"), "_c": F.col("c") + F.col("dx")}).join(b, [*keys, "_r", "_c"], "left")
    return _best(_correlations(met, radius, [*keys, "dy", "dx"]), keys).where(F.col("cc") >= least)


def refine(
    first: DataFrame, second: DataFrame, coarse: DataFrame, search: int, radius: int, block: int, least: float = 0.0, value: str = "v", keys: Sequence[str] = ()
) -> DataFrame:
    """dense_match() around what is known: coarse has keys, r, c, py, px at the same cell size.

    A block of `block` by `block` cells looks around the rounded mean of its
    coarse offsets, `search` cells each way (around 0 where it has none). Its cells
    and a halo of `radius` go with it, so that windows are whole.
    """
    cut = lambda x: F.floor(x / block).cast("int")
    centre = coarse.groupBy(*keys, cut(F.col("r")).alias("_kr"), cut(F.col("c")).alias("_kc"))
    centre = centre.agg(F.rint(F.avg("py")).cast("int").alias("_oy"), F.rint(F.avg("px")).cast("int").alias("_ox"))
    blocks = lambda x: F.explode(F.sequence(cut(F.col(x) - radius), cut(F.col(x) + radius)))
    a = _whole(first, value, keys).withColumn("_kr", blocks("r")).withColumn("_kc", blocks("c"))
    a = a.join(centre, [*keys, "_kr", "_kc"], "left").withColumn("_y", _offsets(search)).withColumn("_x", _offsets(search))
    a = a.withColumns({"dy": F.coalesce("_oy", F.lit(0)) + F.col("_y"), "dx": F.coalesce("_ox", F.lit(0)) + F.col("_x")})
    b = second.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).cast("double").alias("b"))
    met = a.withColumns({"_r": F.col("r") + F.col("dy"), "_c": F.col("c") + F.col("dx")}).join(b, [*keys, "_r", "_c"], "left")
    own = (cut(F.col("r")) == F.col("_kr")) & (cut(F.col("c")) == F.col("_kc"))
    return _best(_correlations(met, radius, [*keys, "_kr", "_kc", "dy", "dx"]).where(own), keys).where(F.col("cc") >= least)


def pyramid_match(
    first: DataFrame, second: DataFrame, levels: int, search: int, radius: int, least: float = 0.0, block: int = 32, value: str = "v", keys: Sequence[str] = ()
) -> DataFrame:
    """dense_match() from coarse to fine: finds offsets up to about search * 2**levels by looking `search` cells around at each level.

    Each level halves the cells of both rasters; its offsets are stored.
    """
    found = None
    for level in range(levels, -1, -1):
        a, b = (zoom_out(x, 2**level, [value], keys=keys) if level else x for x in (first, second))
        if found is None:
            found = dense_match(a, b, search, radius, least if not level else 0.0, value, keys)
        else:
            twice = found.select(*keys, (F.col("r") * 2).alias("r"), (F.col("c") * 2).alias("c"), (F.col("py") * 2).alias("py"), (F.col("px") * 2).alias("px"))
            found = refine(a, b, twice, search, radius, block, least if not level else 0.0, value, keys)
        if level:
            found = stored(found, "match-level")
    return found


def cc_byte(cc: Column) -> Column:
    """A correlation of -1 to 1 as the byte that (byte - 127) / 128 decodes."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(cc * 128 + 127))).cast("int")
