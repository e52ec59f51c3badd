"""Operators that change the grid: averaging, gathering, rotation, de-striping."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.operators.statistics import averages


def zoom_out(df: DataFrame, factor: int, columns: Sequence[str], whole: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Means over factor-by-factor blocks; those of `whole` are rounded, as bytes stay bytes."""
    return df.groupBy(*keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(
        *[F.avg(x).alias(x) for x in columns], *[F.rint(F.avg(x)).cast("int").alias(x) for x in whole]
    )


def pan(b2: Column, b3: Column, b4: Column) -> Column:
    """A panchromatic value of three bands, rounded half to even."""
    return F.rint((b2 * 2 + b3 * 4 + b4 * 4) / F.lit(10.0)).cast("int")


def gather(target: DataFrame, source: DataFrame, at_r: Column, at_c: Column, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """target with the source value at computed integer places, null outside."""
    asked = target.withColumns({"_r": at_r, "_c": at_c})
    src = source.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("got"))
    return asked.join(src, [*keys, "_r", "_c"], "left").drop("_r", "_c")


def cubic_weight(distance: Column, a: float) -> Column:
    """Weight of a cubic convolution at a distance."""
    x = F.abs(distance)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)


def neighbourhoods(source: DataFrame, value: str, size: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The 4 by 4 values from (r - 1, c - 1) to (r + 2, c + 2) of each cell whose square touches the raster: keys, _br, _bc, _taps.

    Two windows, along single rows and then single columns, carry the values to
    their cells, so no row is multiplied. Missing cells count as 0. With a size
    (rows, cols), cells beyond it have the value of the nearest one.
    """
    if size:
        last = [n - 1 for n in size]
        bounds = source.select(*keys).distinct() if keys else source.sparkSession.range(1).select()
        bounds = bounds.select(*keys, F.lit(0).alias("_r0"), F.lit(last[0]).alias("_r1"), F.lit(0).alias("_c0"), F.lit(last[1]).alias("_c1"))
    else:
        bounds = source.groupBy(*keys).agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    wide = lambda low, high: F.explode(F.sequence(F.col(low) - 4, F.col(high) + 4))
    cells = bounds.where("_r0 is not null").withColumn("_br", wide("_r0", "_r1")).withColumn("_bc", wide("_c0", "_c1"))
    near = lambda x, low, high: F.greatest(F.col(low), F.least(F.col(x), F.col(high))) if size else F.col(x)
    cells = cells.withColumns({"_sr": near("_br", "_r0", "_r1"), "_sc": near("_bc", "_c0", "_c1")})
    own = source.select(*keys, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).cast("double").alias("_v"))
    cells = cells.join(own, [*keys, "_sr", "_sc"], "left").select(*keys, "_br", "_bc", F.coalesce("_v", F.lit(0.0)).alias("_v"))
    across, down = Window.partitionBy(*keys, "_br").orderBy("_bc"), Window.partitionBy(*keys, "_bc").orderBy("_br")
    four = lambda x, w: F.array(F.lag(x, 1).over(w), x, F.lead(x, 1).over(w), F.lead(x, 2).over(w))
    rows = cells.select(*keys, "_br", "_bc", four(F.col("_v"), across).alias("_row"))
    return rows.select(*keys, "_br", "_bc", four(F.col("_row"), down).alias("_taps"))


def cubic(
    target: DataFrame, source: DataFrame, y: Column, x: Column, value: str = "v", a: float = -0.75, size: tuple[int, int] | None = None,
    keys: Sequence[str] = (), id_cols: Sequence[str] = ("r", "c"),
) -> DataFrame:
    """Cubic convolution of the source at places y, x: keys, id_cols and `got`.

    Each target meets the neighbourhood of its place in one join. Taps outside
    count as 0, or with a size (rows, cols) of the source as the nearest cell.
    """
    floor = lambda v: F.floor(v).cast("int")
    # so far outside all taps are alike, as near the edge
    held = (lambda v, n: F.greatest(F.lit(-3), F.least(v, F.lit(n + 1)))) if size else (lambda v, n: v)
    rows, cols = size or (0, 0)
    asked = target.select(*keys, *id_cols, y.alias("_y"), x.alias("_x"))
    asked = asked.withColumns({"_br": held(floor(F.col("_y")), rows), "_bc": held(floor(F.col("_x")), cols)})
    met = asked.join(neighbourhoods(source, value, size, keys), [*keys, "_br", "_bc"], "left")
    weight = lambda at, k: cubic_weight(at - F.floor(at) - F.lit(k), a)
    line = lambda i: sum(weight(F.col("_x"), j - 1) * F.get(F.get("_taps", F.lit(i)), F.lit(j)) for j in range(4))
    got = sum(weight(F.col("_y"), i - 1) * line(i) for i in range(4))
    # places that touch no cell have no neighbourhood; the canvas is wider than any square that touches the raster
    return met.select(*keys, *id_cols, F.when(F.col("_y").isNotNull() & F.col("_x").isNotNull(), F.coalesce(got, F.lit(0.0))).alias("got"))


def zoom_in(source: DataFrame, factor: int, rows: int, cols: int, value: str = "v", a: float = -0.75) -> DataFrame:
    """Cubic upsampling by a whole factor with half-pixel centres and replicated borders: r, c, got."""
    each = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = source.select(F.col("r").alias("_r"), F.col("c").alias("_c")).withColumn("_i", F.explode(each)).withColumn("_j", F.explode(each))
    fine = fine.select((F.col("_r") * factor + F.col("_i")).alias("r"), (F.col("_c") * factor + F.col("_j")).alias("c"))
    at = lambda n: (F.col(n) + 0.5) / factor - 0.5
    return cubic(fine, source, at("r"), at("c"), value, a, (rows, cols))


@dataclass(frozen=True)
class Rotation:
    """A rotated canvas: its size, and the inverse map from it to the source."""

    rows: int
    cols: int
    inverse: tuple[float, float, float, float, float, float]  # x = a x' + b y' + e; y = c x' + d y' + f

    def source(self) -> tuple[Column, Column]:
        """Nearest source row and column of the cells r, c."""
        a, b, c, d, e, f = (F.lit(v) for v in self.inverse)
        x = a * F.col("c") + b * F.col("r") + e
        y = c * F.col("c") + d * F.col("r") + f
        return F.floor(y + 0.5).cast("int"), F.floor(x + 0.5).cast("int")


def rotation(rows: int, cols: int, degrees: float) -> Rotation:
    """Rotation about the centre on a canvas that holds the whole image; sizes are truncated."""
    t = math.radians(degrees)
    cos, sin = math.cos(t), math.sin(t)
    cx, cy = cols / 2, rows / 2
    m = [[cos, sin, (1 - cos) * cx - sin * cy], [-sin, cos, sin * cx + (1 - cos) * cy]]
    xs, ys = zip(*[(x * cos + y * sin, -x * sin + y * cos) for x in (-cx, cx) for y in (-cy, cy)])
    width, height = int(abs(max(xs) - min(xs))), int(abs(max(ys) - min(ys)))
    m[0][2] += int(width / 2 - cx)
    m[1][2] += int(height / 2 - cy)
    # the inverse of a rotation is its transpose
    e = -(cos * m[0][2] - sin * m[1][2])
    f = -(sin * m[0][2] + cos * m[1][2])
    return Rotation(height, width, (cos, -sin, sin, cos, e, f))


def canvas(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """All cells of a raster: r, c."""
    ids = df.sparkSession.range(rows).select(F.col("id").cast("int").alias("r"))
    return ids.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))


def rotate(source: DataFrame, rows: int, cols: int, degrees: float, value: str = "v") -> DataFrame:
    """The source on its rotated canvas, nearest cell: r, c, got (null beyond the image)."""
    turn = rotation(rows, cols, degrees)
    at_r, at_c = turn.source()
    return gather(canvas(source, turn.rows, turn.cols), source, at_r, at_c, value)


def destripe(source: DataFrame, rows: int, cols: int, degrees: float, value: str = "v", along: bool = True, across: bool = False, option: str = "median") -> DataFrame:
    """value less the averages of the columns (and rows) of the rotated image: r, c, v, stripe.

    Each source cell takes the profile of the canvas cell that it turns to, which
    is the inverse rotation with the intended shift on both axes. Row averages are
    those of the input, not of what is left after the columns. option: median,
    mean, or mode (of 3 decimals, the smallest of equals).
    """
    turn = rotation(rows, cols, degrees)
    rotated = rotate(source, rows, cols, degrees, value)
    a, b, c, d, e, f = turn.inverse
    # forward map: transpose of the inverse's linear part
    x, y = F.col("c") - F.lit(e), F.col("r") - F.lit(f)
    rc = F.floor(F.lit(a) * x + F.lit(c) * y + 0.5).cast("int")
    rr = F.floor(F.lit(b) * x + F.lit(d) * y + 0.5).cast("int")
    out = source.select("r", "c", F.col(value).alias("v")).withColumns({"rr": rr, "rc": rc})
    total = F.lit(0.0)
    if along:
        profile = averages(rotated, ["c"], "got", option).select(F.col("c").alias("rc"), F.col("m").alias("along"))
        out, total = out.join(profile, "rc", "left"), total + F.coalesce("along", F.lit(0.0))
    if across:
        profile = averages(rotated, ["r"], "got", option).select(F.col("r").alias("rr"), F.col("m").alias("across"))
        out, total = out.join(profile, "rr", "left"), total + F.coalesce("across", F.lit(0.0))
    return out.select("r", "c", (F.col("v") - total).alias("v"), total.alias("stripe"))


def warp_parameters(bands: DataFrame) -> DataFrame:
    """Distinct target grids of correction grids snapped to the bands' pixels.

    bands: g_ulx, g_uly, g_xres, g_yres of the band and ulx, uly, xres, yres,
    rows, cols of the correction grid. Rounds half to even.
    """
    left = F.rint((F.col("ulx") - F.col("g_ulx")) / F.col("g_xres"))
    top = F.rint((F.col("uly") - F.col("g_uly")) / F.col("g_yres"))
    return bands.select(
        F.col("g_xres").alias("res"),
        (F.col("g_ulx") + left * F.col("g_xres")).alias("xmin"),
        (F.col("g_uly") + top * F.col("g_yres")).alias("ymax"),
        F.rint(F.col("cols") / (F.col("g_xres") / F.col("xres"))).cast("int").alias("out_cols"),
        F.rint(F.col("rows") / (F.col("g_yres") / F.col("yres"))).cast("int").alias("out_rows"),
    ).distinct()


def remap(source: DataFrame, shifts: DataFrame, nearest: bool = False) -> DataFrame:
    """Source values at (r + py, c + px) of the cells of shifts, rounded to unsigned 16 bit: r, c, v.

    Places outside the source count as 0.
    """
    y, x = F.col("r") + F.col("py"), F.col("c") + F.col("px")
    if nearest:
        got = gather(shifts, source, F.rint(y).cast("int"), F.rint(x).cast("int")).select("r", "c", F.coalesce("got", F.lit(0)).alias("got"))
    else:
        got = cubic(shifts, source, y, x)
    return got.select("r", "c", F.pmod(F.rint("got").cast("long"), F.lit(65536)).cast("int").alias("v"))


def same_grid(a: dict, b: dict) -> bool:
    """Whether two grids (ulx, uly, xres, yres) are one, so that aligning would change nothing."""
    return all(a[k] == b[k] for k in ("ulx", "uly", "xres", "yres"))


def align(
    source: DataFrame, of: dict, to: dict, rows: int, cols: int, nearest: bool = True,
    change: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """The source (r, c, v) on another grid of rows by cols: r, c, v, null outside with nearest cells.

    change gives the coordinates of a place of the new grid in those of the
    source's (a struct of x, y), where the two have different projections. Grids that are one are
    returned as they are, with no join.
    """
    if same_grid(of, to) and change is None:
        return source
    y = F.lit(float(to["uly"])) + (F.col("r") + 0.5) * to["yres"]
    x = F.lit(float(to["ulx"])) + (F.col("c") + 0.5) * to["xres"]
    target = canvas(source, rows, cols)
    if change:
        target = target.withColumn("_at", change(x, y))
        x, y = F.col("_at.x"), F.col("_at.y")
    y, x = (y - of["uly"]) / of["yres"] - 0.5, (x - of["ulx"]) / of["xres"] - 0.5
    if nearest:
        got = gather(target, source, F.floor(y + 0.5).cast("int"), F.floor(x + 0.5).cast("int"))
    else:
        got = cubic(target, source, y, x, a=-0.5, size=_size(source))
    return got.select("r", "c", F.col("got").alias("v"))


def area_resample(
    df: DataFrame, scale_r: float, scale_c: float, rows: int, cols: int, columns: Sequence[str], masks: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Means of `columns` over cells of scale_r by scale_c source cells, by the shares of area that they overlap: keys, r, c, columns, masks.

    Any factor: a source cell goes to the targets that it touches, at most four
    if no scale is below one. Null values have no weight, and a mean over none is
    null. masks are columns of 0 and 1 (or booleans); a target is masked where
    more than half of its covered area is. rows, cols: the size of the new raster.
    """

    def touched(at: str, scale: float, n: int) -> Column:
        last = F.ceil((F.col(at) + 1) / F.lit(float(scale))).cast("int") - 1
        first = F.floor(F.col(at) / F.lit(float(scale))).cast("int")
        return F.explode(F.when(first < n, F.sequence(first, F.least(last, F.lit(n - 1)))))

    def overlap(at: str, to: str, scale: float) -> Column:
        s = F.lit(float(scale))
        return F.least(F.col(at) + 1, (F.col(to) + 1) * s) - F.greatest(F.col(at).cast("double"), F.col(to) * s)

    sent = df.withColumn("_r", touched("r", scale_r, rows)).withColumn("_c", touched("c", scale_c, cols))
    w = F.col("_w")
    sent = sent.withColumn("_w", overlap("r", "_r", scale_r) * overlap("c", "_c", scale_c)).where("_w > 1e-12")
    mean = lambda x: F.try_divide(F.sum(w * F.col(x)), F.sum(F.when(F.col(x).isNotNull(), w)))
    half = lambda x: F.sum(w * F.col(x).cast("int")) / F.sum(w) > 0.5
    out = sent.groupBy(*keys, F.col("_r").alias("_tr"), F.col("_c").alias("_tc")).agg(*[mean(x).alias(x) for x in columns], *[half(x).alias(x) for x in masks])
    return out.select(*keys, F.col("_tr").alias("r"), F.col("_tc").alias("c"), *columns, *masks)


def _size(source: DataFrame) -> tuple[int, int]:
    last = source.agg(F.max("r"), F.max("c")).first()
    return (last[0] or 0) + 1, (last[1] or 0) + 1


def warp_offsets(source: DataFrame, of: dict, to: dict, rows: int, cols: int, res_ref: float = 1.0) -> DataFrame:
    """Offsets on another grid, still in pixels of the target: aligned values over (new resolution / res_ref)."""
    return align(source, of, to, rows, cols).withColumn("v", F.col("v") / F.lit(to["xres"] / res_ref))


def grids_by_resolution(bands: DataFrame, grids: DataFrame) -> DataFrame:
    """Bands with the correction grid of their resolution; pixels must be square and each resolution must have a grid."""
    square = F.when(F.abs("xres") == F.abs("yres"), F.abs("xres").cast("int")).otherwise(F.raise_error(F.lit("pixels are not square")).cast("int"))
    found = bands.withColumn("res", square).join(grids, "res", "left")
    return found.withColumn("grid", F.when(F.col("grid").isNotNull(), F.col("grid")).otherwise(F.raise_error(F.lit("a resolution has no grid"))))
