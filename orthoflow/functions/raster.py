"""Scalar functions of rasters, as Column expressions. Masked is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cc_python(cc: Column) -> Column:
    """Correlation of a byte, decoded with the offset 127."""
    return (cc.cast("int") - 127) / F.lit(128.0)


def cc_stack(cc: Column) -> Column:
    """Correlation of a byte, decoded with the offset 128, as displacement stacks do."""
    return (cc.cast("int") - 128) / F.lit(127.0)


def mask_low_cc(value: Column, cc: Column, threshold: float) -> Column:
    """value, or null where the decoded correlation is below the threshold."""
    return F.when(cc_python(cc) >= threshold, value)


def mask_low_cc_raw(value: Column, cc: Column, threshold: float) -> Column:
    """The same on the raw byte: null where cc < threshold * 128 + 127."""
    if not 0 <= threshold < 1:
        raise ValueError("the threshold must be in [0, 1)")
    return F.when(cc >= threshold * 128 + 127, value)


def mask_large(value: Column, most: float) -> Column:
    """value, or null where it is larger than most; both by absolute value."""
    return F.when(F.abs(value) <= abs(most), value)


def within(value: Column, low: float, high: float) -> Column:
    """value, or null outside low..high."""
    return F.when(value.between(low, high), value)


def strictly_within(value: Column, low: Column, high: Column) -> Column:
    return F.when((value > low) & (value < high), value)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def recode(cls: Column, members: list[int], inside: int = 1, outside: int = 0) -> Column:
    """All classes at once, so that a new value is never recoded again."""
    return F.when(cls.isin(members), inside).otherwise(outside)


def uint16(value: Column) -> Column:
    """Half-even rounding, then wrap-around as an unsigned 16-bit cast."""
    return F.pmod(F.rint(value).cast("long"), F.lit(65536)).cast("int")


def pixel_to_map(index: Column, origin: float, resolution: float) -> Column:
    return index * F.lit(float(resolution)) + F.lit(float(origin))


def map_to_pixel(x: Column, origin: float, resolution: float) -> Column:
    """Truncates towards zero; only for square pixels, as rows use the same size."""
    return ((x - F.lit(float(origin))) / F.lit(float(resolution))).cast("int")


def linspace(index: Column, count: Column | int) -> Column:
    """Coordinate in -1..1 of a row or column number."""
    n = count if isinstance(count, Column) else F.lit(count)
    return F.lit(-1.0) + F.lit(2.0) * index / (n - 1)


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Min-max stretch to 0..255; a flat field becomes 0."""
    return F.coalesce(F.floor(F.try_divide((value - low) * F.lit(255.0), high - low)), F.lit(0)).cast("int")


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """a, b, c of the line a x + b y = c through two points."""
    return F.struct((y1 - y2).alias("a"), (x2 - x1).alias("b"), (-(x1 * y2 - x2 * y1)).alias("c"))


def intersection(p: Column, q: Column) -> Column:
    """Point where two lines cross, by Cramer's rule; null if they are parallel."""
    d = p["a"] * q["b"] - p["b"] * q["a"]
    x, y = p["c"] * q["b"] - p["b"] * q["c"], p["a"] * q["c"] - p["c"] * q["a"]
    return F.when(d != 0, F.struct((x / d).alias("x"), (y / d).alias("y")))


def project(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Foot of the perpendicular from a point on the line through two points; null if they are one."""
    dx, dy = x2 - x1, y2 - y1
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    return F.when(t.isNotNull(), F.struct((x1 + t * dx).alias("x"), (y1 + t * dy).alias("y")))


def edge_angle(dx: Column, dy: Column) -> Column:
    """Angle of an edge against the vertical, in degrees."""
    return 90 - F.degrees(F.atan2(F.abs(dy), F.abs(dx)))


def search_area(uncertainty: Column) -> Column:
    """Size of the search area of dense matching for an uncertainty in pixels."""
    return F.ceil(uncertainty * 0.8) + 2


def normal_density(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * F.sqrt(2 * F.pi()))


def two_dates(name: Column) -> Column:
    """The two dates in a folder name: 8 digits from 20, each followed by 7 digits; null if there are none."""
    # fixed value: the form of dates and times in the names
    pattern = r"(20[0-9]{6})[0-9]{7}.*(20[0-9]{6})[0-9]{7}"
    one = lambda k: F.to_date(F.regexp_extract(name, pattern, k), "yyyyMMdd")
    return F.when(name.rlike(pattern), F.struct(one(1).alias("date1"), one(2).alias("date2")))


def wkt(ring: Column) -> Column:
    """Well-known text of a ring of points x, y."""
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))
