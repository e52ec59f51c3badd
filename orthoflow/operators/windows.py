"""Moving windows over rasters and stacks.

A box window is two one-dimensional windows one behind the other: sums, counts,
minima and maxima along rows, then the same along columns. Partitions are single
rows or columns of a raster, so no task needs a whole image. Frames are RANGE
frames, which stay right where cells are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.functions.raster import cc_stack, hypot
from orthoflow.sources.rasters import blocks


def densify(df: DataFrame, rows: int, cols: int, fill: dict[str, object], r: str = "r", c: str = "c") -> DataFrame:
    """All cells of a rows-by-cols raster; new ones hold fill."""
    spark = df.sparkSession
    cells = spark.range(rows).select(F.col("id").cast("int").alias(r)).withColumn(
        c, F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    out = cells.join(df, [r, c], "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items() if v is not None})


def filled(df: DataFrame, keys: Sequence[str] = (), r: str = "r", c: str = "c") -> DataFrame:
    """df with a row for every cell of its bounding box, by key; `_own` is true for those of df.

    A window that runs along rows and then along columns needs the cells between.
    """
    box_ = df.groupBy(*keys).agg(F.min(r).alias("_r0"), F.max(r).alias("_r1"), F.min(c).alias("_c0"), F.max(c).alias("_c1"))
    rows = box_.where("_r0 is not null").withColumn(r, F.explode(F.sequence("_r0", "_r1")))
    cells = rows.withColumn(c, F.explode(F.sequence("_c0", "_c1"))).select(*keys, r, c)
    own = df.withColumn("_own", F.lit(True))
    return cells.join(own, [*keys, r, c], "left").withColumn("_own", F.coalesce("_own", F.lit(False)))


def box(
    df: DataFrame, columns: Sequence[str], radius: int, keys: Sequence[str] = (), agg: Callable[[Column], Column] = F.sum, r: str = "r", c: str = "c"
) -> DataFrame:
    """df with b_<column>: agg over the square of 2*radius+1 cells; agg must be separable."""
    across = Window.partitionBy(*keys, r).orderBy(c).rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, c).orderBy(r).rangeBetween(-radius, radius)
    half = df.withColumns({f"b_{x}": agg(F.col(x)).over(across) for x in columns})
    return half.withColumns({f"b_{x}": agg(F.col(f"b_{x}")).over(down) for x in columns})


def block_mean(df: DataFrame, value: str, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """df with `filtered`: mean of the values that are not null, over the square and all rows of a cell."""
    cells = df.groupBy(*keys, "r", "c").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return box(filled(cells, keys), ["s", "n"], radius, keys).where("_own").select(
        *keys, "r", "c", F.try_divide(F.col("b_s"), F.col("b_n")).alias("filtered")
    )


def block_median(df: DataFrame, value: str, radius: int, keys: Sequence[str] = (), size: int = 64) -> DataFrame:
    """As block_mean(), with the exact median.

    Cells are sent to blocks of `size` cells with a halo of the radius, about
    once for each cell, and a task holds one block.
    """
    import numpy as np
    import pandas as pd

    names = [*keys, "r", "c"]
    cells = df.select(*names, F.col(value).cast("double").alias("_v"))
    parts = blocks(cells, size, radius)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields], "filtered double"])

    def medians(group: pd.DataFrame) -> pd.DataFrame:
        at = [group["br"].to_numpy(), group["bc"].to_numpy()]
        depth = group.groupby(["br", "bc"]).cumcount().to_numpy()
        full = np.full((size + 2 * radius, size + 2 * radius, int(depth.max()) + 1), np.nan)
        full[at[0], at[1], depth] = group["_v"].to_numpy()
        own = group[group["own"].to_numpy() & (depth == 0)]
        around = np.lib.stride_tricks.sliding_window_view(full, (2 * radius + 1, 2 * radius + 1), axis=(0, 1))
        out = np.full(len(own), np.nan)
        rows, cols = own["br"].to_numpy() - radius, own["bc"].to_numpy() - radius
        step = max(1, 4_000_000 // (full.shape[2] * (2 * radius + 1) ** 2))
        for lo in range(0, len(own), step):
            found = np.sort(around[rows[lo : lo + step], cols[lo : lo + step]].reshape(len(rows[lo : lo + step]), -1), axis=1)  # nan last
            n = (~np.isnan(found)).sum(axis=1)
            pick = lambda k: np.take_along_axis(found, np.maximum(k, 0)[:, None], 1)[:, 0]  # noqa: B023, E731
            out[lo : lo + step] = np.where(n > 0, pick((n - 1) // 2) * 0.5 + pick(n // 2) * 0.5, np.nan)
        return own[names].assign(filtered=pd.Series(out, index=own.index).astype(object).where(~np.isnan(out), None))

    return parts.groupBy(*keys, "block_r", "block_c").applyInPandas(medians, schema)


def disk(radius_r: int, radius_c: int) -> list[tuple[int, int]]:
    """Offsets of a ball element; a radius of zero is flat in that direction."""
    inside = lambda a, b: (a / (radius_r or 1)) ** 2 + (b / (radius_c or 1)) ** 2 <= 1
    return [(a, b) for a in range(-radius_r, radius_r + 1) for b in range(-radius_c, radius_c + 1) if inside(a, b)]


def disk_boxes(radius_r: int, radius_c: int) -> list[tuple[int, int]]:
    """Half heights and half widths of the boxes that together cover just the disk, one for each width."""
    reach: dict[int, int] = {}
    for a, b in disk(radius_r, radius_c):
        reach[abs(a)] = max(reach.get(abs(a), 0), abs(b))
    tallest: dict[int, int] = {}
    for a, b in reach.items():
        tallest[b] = max(tallest.get(b, 0), a)
    return [(a, b) for b, a in sorted(tallest.items())]


def _morph(df: DataFrame, agg: Callable, boxes: list[tuple[int, int]], keys: Sequence[str]) -> DataFrame:
    """agg (max or min) over a union of boxes around each cell of filled(): a frame a box along rows, one along columns."""
    across = Window.partitionBy(*keys, "r").orderBy("c")
    down = Window.partitionBy(*keys, "c").orderBy("r")
    wide = df.withColumns({f"_w{b}": agg("v").over(across.rangeBetween(-b, b)) for _, b in boxes})
    tall = wide.withColumns({f"_w{b}": agg(f"_w{b}").over(down.rangeBetween(-a, a)) for a, b in boxes})
    best = F.greatest if agg is F.max else F.least
    found = best(*[f"_w{b}" for _, b in boxes]) if len(boxes) > 1 else F.col(f"_w{boxes[0][1]}")
    return tall.select(*keys, "r", "c", "_own", F.when(F.col("_own"), found).alias("v"))


def close_open(
    df: DataFrame, close_radius: float | None, open_radius: float | None, resolution: float = 1.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Morphological closing, then opening, of v with ball elements; radii are in map units.

    Cells beyond the raster do not count. At least one radius must be given.
    A ball is a union of boxes, so each step is two sorts whatever its radius.
    """
    if close_radius is None and open_radius is None:
        raise ValueError("a radius to close or to open with is needed")
    df = filled(df.select(*keys, "r", "c", "v"), keys)
    for radius, steps in ((close_radius, (F.max, F.min)), (open_radius, (F.min, F.max))):
        if radius is not None:
            n = round(radius / resolution)
            for step in steps:
                df = _morph(df, step, disk_boxes(n, n), keys)
    return df.where("_own").select(*keys, "r", "c", "v")


@dataclass(frozen=True)
class StackParameters:
    """Parameters of stack statistics; defaults as published."""

    window: int = 11
    min_cc: float = 0.333
    min_displacement: float = 0.15
    min_matches: float = 0.4
    layers: int | None = None
    max_layers: int | None = None
    only_multitemporal: bool = True

    def __post_init__(self) -> None:
        if self.window < 1 or self.window % 2 == 0:
            raise ValueError("the window must be odd")
        if not 0 <= self.min_matches <= 1:
            raise ValueError("min_matches must be in 0..1")


def mark_na(stack: DataFrame, min_cc: float) -> DataFrame:
    """Vectors of low correlation become 0, not null, and count as na."""
    low = cc_stack(F.col("cc")) < min_cc
    return stack.withColumns(
        {"na": low.cast("int"), "ew": F.when(low, 0).otherwise(F.col("ew")), "ns": F.when(low, 0).otherwise(F.col("ns"))}
    )


def pixel_sums(stack: DataFrame, min_cc: float, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over the layers of a pixel: ew, ns, path (lengths) and na."""
    return (
        mark_na(stack, min_cc)
        .groupBy(*keys, "r", "c")
        .agg(
            F.sum("ew").alias("ew"),
            F.sum("ns").alias("ns"),
            F.sum(hypot(F.col("ew"), F.col("ns"))).alias("path"),
            F.sum("na").alias("na"),
        )
    )


def mean_magnitude(sums: DataFrame, layers: int) -> DataFrame:
    """Length of the mean vector of the layers that are not na; null if there is none."""
    used = F.lit(layers) - F.col("na")
    return sums.withColumn("mean_magn", hypot(F.try_divide(F.col("ew"), used), F.try_divide(F.col("ns"), used)))


def mean_velocity(stack: DataFrame, min_cc: float, layers: int, duration: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of displacement by duration, for both axes."""
    rate = lambda x: F.sum(F.try_divide(F.col(x), F.col(duration)))
    used = F.lit(layers) - F.sum("na")
    return mark_na(stack, min_cc).groupBy(*keys, "r", "c").agg(
        F.try_divide(rate("ew"), used).alias("veloc_ew"), F.try_divide(rate("ns"), used).alias("veloc_ns")
    )


def vector_coherence(stack: DataFrame, p: StackParameters, layers: int, rows: int, cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """Length of the window's vector sum over the sum of lengths, 0 where not processed.

    The limit of na is layers * (1 - min_matches) for a pixel and
    window**2 * layers * min_matches for a block; windows shrink at borders.
    """
    sums = pixel_sums(stack, p.min_cc, keys)
    if keys:
        empty = {"ew": 0, "ns": 0, "path": 0.0, "na": 0}
        sums = filled(sums, keys).withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in empty.items()}).drop("_own")
    else:
        sums = densify(sums, rows, cols, {"ew": 0, "ns": 0, "path": 0.0, "na": 0})
    full = box(mean_magnitude(sums, layers), ["ew", "ns", "path", "na"], p.window // 2, keys)
    processed = (
        (F.col("mean_magn") > p.min_displacement)
        & (F.col("na") <= layers * (1 - p.min_matches))
        & ~(F.col("b_na") > p.window**2 * layers * p.min_matches)
    )
    vc = F.try_divide(hypot(F.col("b_ew"), F.col("b_ns")), F.col("b_path"))
    return full.withColumn("vc", F.when(processed, vc).otherwise(0.0))


def stack_products(stack: DataFrame, p: StackParameters, layers: int, rows: int, cols: int, duration: str) -> DataFrame:
    """Coherence, mean magnitude, na count and mean velocities of a stack in one table."""
    base = vector_coherence(stack, p, layers, rows, cols).select("r", "c", "vc", "mean_magn", "na")
    return base.join(mean_velocity(stack, p.min_cc, layers, duration), ["r", "c"], "left")


def option_error(o: dict[str, Column]) -> Column:
    """What is wrong with a row of options (window, only_multitemporal, min_matches, folder, layers, max_layers), null if nothing is."""
    one = F.when(o["folder"].isNotNull(), 1).otherwise(0) + F.when(o["layers"].isNotNull(), 1).otherwise(0)
    return (
        F.when((o["window"] < 1) | (o["window"] % 2 == 0), "the window must be odd")
        .when(~o["only_multitemporal"].isin(0, 1), "only_multitemporal must be 0 or 1")
        .when((o["min_matches"] < 0) | (o["min_matches"] > 1), "min_matches must be in 0..1")
        .when(one != 1, "either a folder or layers must be given")
        .when(o["max_layers"].isNotNull() & o["layers"].isNotNull(), "max_layers needs a folder")
    )


def denoise_frames(df: DataFrame, key: str, h: float = 2.0, search: int = 21, patch: int = 7, window: int | None = None) -> DataFrame:
    """Non-local means of the middle frame of each stack (key, frames: arrays of rows of floats): key, data.

    The frames of a stack are stretched to bytes together. Each pixel becomes the
    mean of the pixels of its search window in `window` frames round the middle
    one (an odd number; all of them if none is given), weighted by the likeness
    of their patches. Frames of a stack have one size and fit one task.
    """
    import pandas as pd

    if window is not None and window % 2 == 0:
        raise ValueError("the window of frames must be odd")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            done = []
            for frames in batch["frames"]:
                x = np.array([[np.asarray(row, float) for row in frame] for frame in frames])
                low, high = np.nanmin(x), np.nanmax(x)
                y = (x - low) / (high - low) * 255 if high > low else np.zeros_like(x)
                half, s, middle = patch // 2, search // 2, len(y) // 2
                reach = len(y) if window is None else window // 2
                y = y[max(0, middle - reach) : middle + reach + 1]
                shape = y.shape[1:]
                mode = "reflect" if min(shape) > half + s else "edge"
                padded = [np.pad(f, half + s, mode=mode) for f in y]
                core = padded[min(middle, reach)][s : -s or None, s : -s or None]
                total, weight = np.zeros(shape), np.zeros(shape)
                for frame in padded:
                    for dr in range(-s, s + 1):
                        for dc in range(-s, s + 1):
                            moved = frame[s + dr : s + dr + core.shape[0], s + dc : s + dc + core.shape[1]]
                            apart = np.pad((core - moved) ** 2, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
                            dist = (apart[patch:, patch:] - apart[:-patch, patch:] - apart[patch:, :-patch] + apart[:-patch, :-patch]) / patch**2
                            w = np.exp(-dist / (h * h))
                            total += w * moved[half : half + shape[0], half : half + shape[1]]
                            weight += w
                done.append((total / weight / 255 * (high - low) + low).tolist())
            yield pd.DataFrame({key: batch[key], "data": done})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "frames").mapInPandas(run, f"{key} {kind}, data array<array<double>>")


def denoise_tiles(df: DataFrame, key: str, h: float = 2.0, search: int = 21, patch: int = 7) -> DataFrame:
    """denoise_frames() of single tiles (key, data)."""
    return denoise_frames(df.select(key, F.array("data").alias("frames")), key, h, search, patch)
