"""Correction surfaces: plane, detector offsets and stripes taken off displacements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.functions.raster import linspace, mask_large, mask_low_cc
from orthoflow.operators.geometry import zone_statistics, zones
from orthoflow.operators.gridding import canvas, remap, warp_offsets, zoom_out
from orthoflow.operators.statistics import Plane, fit_plane, fit_planes, gaussian_clip, gaussian_clips, outlier_mask, stage_statistics
from orthoflow.sources.scratch import stored


@dataclass(frozen=True)
class CorrectionParameters:
    """Parameters of an estimation; cc_threshold is on decoded correlations."""

    rows: int
    cols: int
    factor: int = 4
    iterations: int = 3
    cc_threshold: float = 0.33
    max_displacement: float = 9999
    option: str = "median"
    clip: float | None = None


@dataclass
class Correction:
    """A plane, offsets by detector, and statistics by stage (stage, mean, std, rmse, max, min, n)."""

    plane: Plane
    offsets: DataFrame
    log: DataFrame
    sigma: float


def estimate(field: DataFrame, rings: DataFrame | None, p: CorrectionParameters) -> Correction:
    """Correction of one axis (r, c, v, cc) from its zoomed, masked field.

    The plane is robust; then the average residual of each detector is taken off
    (always, whether or not anything is displayed). Without rings only the plane
    is. sigma is that of the clipped residuals, for outlier masks later on.
    """
    small = zoom_out(field, p.factor, ["v"], ["cc"])
    kept = small.select(
        "r", "c", linspace(F.col("c"), -(-p.cols // p.factor)).alias("x"), linspace(F.col("r"), -(-p.rows // p.factor)).alias("y"),
        mask_large(mask_low_cc(F.col("v"), F.col("cc"), p.cc_threshold), p.max_displacement).alias("z"),
    ).where("z is not null")
    kept = stored(kept, "kept")
    plane = fit_plane(kept, p.iterations)
    flat = kept.select("r", "c", "z", (F.col("z") - plane.at(F.col("x"), F.col("y"))).alias("v"))
    stages = [kept.select(F.lit("input").alias("stage"), F.col("z").alias("v")), flat.select(F.lit("plane_corrected").alias("stage"), "v")]
    offsets = None
    if rings is not None:
        half = p.factor // 2
        centre = flat.select((F.col("r") * p.factor + half).alias("r"), (F.col("c") * p.factor + half).alias("c"), "v")
        zoned = zones(centre, rings)
        offsets = stored(zone_statistics(zoned, p.option, "v", p.clip).select("det_id", F.col("average").alias("offset")), "offsets")
        # one row for each detector of a scene
        flat = zoned.join(offsets, "det_id").select((F.col("v") - F.col("offset")).alias("v"))
        stages.append(flat.select(F.lit("destripe").alias("stage"), "v"))
    log = stages[0]
    for s in stages[1:]:
        log = log.unionByName(s)
    return Correction(plane, offsets, stage_statistics(log, "v", ["stage"]), gaussian_clip(flat, "v").sigma)


def apply(field: DataFrame, found: Correction, rings: DataFrame | None, p: CorrectionParameters, mask_cc: bool = True) -> DataFrame:
    """field (r, c, v, cc) at full resolution less the correction: r, c, v.

    The plane is evaluated on the fine grid, with the zoomed grid's cell centres
    in their place. Cells of no detector only lose the plane.
    """
    small_rows, small_cols = -(-p.rows // p.factor), -(-p.cols // p.factor)
    fine = lambda n: (F.col(n) + 0.5) / p.factor - 0.5
    x, y = linspace(fine("c"), small_cols), linspace(fine("r"), small_rows)
    v = F.col("v") - found.plane.at(x, y)
    if rings is not None:
        field = field.join(zones(field.select("r", "c"), rings), ["r", "c"], "left").join(F.broadcast(found.offsets), "det_id", "left")
        v = v - F.coalesce("offset", F.lit(0.0))
    if mask_cc:
        v = mask_low_cc(v, F.col("cc"), p.cc_threshold)
    return field.select("r", "c", mask_large(v, p.max_displacement).alias("v"))


@dataclass
class Corrections:
    """What estimate() finds, by key: planes (key, a, b, c), offsets (key, det_id, offset), log (key, stage, ...), sigmas (key, sigma)."""

    planes: DataFrame
    offsets: DataFrame | None
    log: DataFrame
    sigmas: DataFrame


def estimate_pairs(fields: DataFrame, key: str, rings: DataFrame | None, p: CorrectionParameters) -> Corrections:
    """estimate() of every pair at once; fields has key, r, c, v, cc, and rings hold for all pairs."""
    small = zoom_out(fields, p.factor, ["v"], ["cc"], [key])
    x, y = linspace(F.col("c"), -(-p.cols // p.factor)), linspace(F.col("r"), -(-p.rows // p.factor))
    kept = small.select(
        key, "r", "c", x.alias("x"), y.alias("y"),
        mask_large(mask_low_cc(F.col("v"), F.col("cc"), p.cc_threshold), p.max_displacement).alias("z"),
    ).where("z is not null")
    kept = stored(kept, "kept")
    planes = fit_planes(kept, key, p.iterations).select(key, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c"))
    surface = F.col("_a") * F.col("x") + F.col("_b") * F.col("y") + F.col("_c")
    flat = kept.join(planes, key).select(key, "r", "c", "z", (F.col("z") - surface).alias("v"))
    stages = [kept.select(key, F.lit("input").alias("stage"), F.col("z").alias("v")), flat.select(key, F.lit("plane_corrected").alias("stage"), "v")]
    offsets = None
    if rings is not None:
        half = p.factor // 2
        zoned = zones(flat.select(key, (F.col("r") * p.factor + half).alias("r"), (F.col("c") * p.factor + half).alias("c"), "v"), rings)
        offsets = stored(zone_statistics(zoned, p.option, "v", p.clip, [key]).select(key, "det_id", F.col("average").alias("offset")), "offsets")
        flat = zoned.join(offsets, [key, "det_id"]).select(key, (F.col("v") - F.col("offset")).alias("v"))
        stages.append(flat.select(key, F.lit("destripe").alias("stage"), "v"))
    log = stages[0]
    for s in stages[1:]:
        log = log.unionByName(s)
    return Corrections(planes, offsets, stage_statistics(log, "v", [key, "stage"]), gaussian_clips(flat, key, "v").select(key, "sigma"))


def apply_pairs(fields: DataFrame, key: str, found: Corrections, rings: DataFrame | None, p: CorrectionParameters, mask_cc: bool = True) -> DataFrame:
    """apply() of every pair at once: key, r, c, v."""
    fine = lambda n: (F.col(n) + 0.5) / p.factor - 0.5
    x, y = linspace(fine("c"), -(-p.cols // p.factor)), linspace(fine("r"), -(-p.rows // p.factor))
    fields = fields.join(found.planes, key, "left")
    v = F.col("v") - (F.col("_a") * x + F.col("_b") * y + F.col("_c"))
    if rings is not None:
        fields = fields.join(zones(fields.select("r", "c").distinct(), rings), ["r", "c"], "left").join(found.offsets, [key, "det_id"], "left")
        v = v - F.coalesce("offset", F.lit(0.0))
    if mask_cc:
        v = mask_low_cc(v, F.col("cc"), p.cc_threshold)
    return fields.select(key, "r", "c", mask_large(v, p.max_displacement).alias("v"))


AXES = ("px1", "px2")


@dataclass
class CorrectedPairs:
    """Corrected fields (pair, r, c, px1, px2), what was taken off each axis (key `pair:axis`), and output errors (pair, rmse_xy, n)."""

    fields: DataFrame
    found: Corrections
    errors: DataFrame


def by_axis(fields: DataFrame, pair: str) -> DataFrame:
    """A row for each axis of fields (pair, r, c, px1, px2, cc): axis_key, pair, axis, r, c, v, cc."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in AXES]))
    rows = fields.select(pair, "r", "c", "cc", each.alias("_e"))
    key = F.concat_ws(":", F.col(pair).cast("string"), "_e.axis").alias("axis_key")
    return rows.select(key, pair, F.col("_e.axis").alias("axis"), "r", "c", F.col("_e.v").alias("v"), "cc")


def output_errors(fields: DataFrame, sigmas: DataFrame, pair: str) -> DataFrame:
    """Root mean square of px1, px2 together over the pixels where both are within SIGMAS of their own sigma round 0.

    fields: pair, r, c, px1, px2; sigmas: axis_key, sigma.
    """
    limits = sigmas.select(F.substring_index("axis_key", ":", 1).alias("_p"), F.substring_index("axis_key", ":", -1).alias("_a"), "sigma")
    limits = limits.groupBy("_p").agg(*[F.max(F.when(F.col("_a") == a, F.col("sigma"))).alias(f"_{a}") for a in AXES])
    kept = fields.join(limits, F.col(pair).cast("string") == F.col("_p")).select(
        pair, *[outlier_mask(F.col(a), F.col(f"_{a}")).alias(a) for a in AXES]
    )
    both = kept.where("px1 is not null and px2 is not null").groupBy(pair)
    return both.agg(F.sqrt(F.avg(F.col("px1") * F.col("px1") + F.col("px2") * F.col("px2"))).alias("rmse_xy"), F.count(F.lit(1)).alias("n"))


def correct_all(fields: DataFrame, pair: str, rings: DataFrame | None, p: CorrectionParameters) -> CorrectedPairs:
    """Both axes of all pairs in one plan: robust planes, detector offsets, masks, and errors of what is left.

    fields has pair, r, c, px1, px2, cc. Every step is keyed by pair and axis, so
    its cost is one pass over all pixels whatever the number of pairs. Pairs of
    sensors without detectors are those without rings.
    """
    long = by_axis(fields, pair)
    found = estimate_pairs(long, "axis_key", rings, p)
    done = apply_pairs(long, "axis_key", found, rings, p)
    axis = F.substring_index("axis_key", ":", -1)
    pick = [F.max(F.when(axis == a, F.col("v"))).alias(a) for a in AXES]
    names = F.substring_index("axis_key", ":", 1).cast(dict(fields.dtypes)[pair]).alias(pair)
    corrected = stored(done.groupBy(names, "r", "c").agg(*pick), "corrected-pairs")
    return CorrectedPairs(corrected, found, output_errors(corrected, found.sigmas, pair))


def correct_bands(
    bands: dict[str, tuple[DataFrame, dict]], offsets: DataFrame, of: dict, res_ref: float = 1.0, nearest: bool = False
) -> DataFrame:
    """Bands moved by the offsets of a corrected pair: band, r, c, v.

    bands: name to pixels (r, c, v) and grid (ulx, uly, xres, yres, rows, cols);
    offsets: r, c, px1 (columns), px2 (rows) on grid `of`. All cells of a band's grid
    have a row; where offsets are masked it keeps its place. Offsets are aligned
    once for each different grid, with the grid of `of` not at all; a grid beyond
    `of` is an error. Bands of one grid share the aligned offsets.
    """
    out = None
    grids: dict[tuple, DataFrame] = {}
    for name, (pixels, to) in bands.items():
        place = tuple(to[k] for k in ("ulx", "uly", "xres", "yres", "rows", "cols"))
        if place not in grids:
            _covered(of, to)
            px, py = (
                warp_offsets(offsets.select("r", "c", F.col(a).alias("v")), of, to, to["rows"], to["cols"], res_ref).withColumnRenamed("v", n)
                for a, n in zip(AXES, ("px", "py"))
            )
            cells = canvas(pixels, to["rows"], to["cols"]).join(px, ["r", "c"], "left").join(py, ["r", "c"], "left")
            grids[place] = cells.select("r", "c", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("px", "py")])
        moved = remap(pixels, grids[place], nearest).select(F.lit(name).alias("band"), "r", "c", "v")
        out = moved if out is None else out.unionByName(moved)
    if out is None:
        raise ValueError("no bands")
    return out


def _covered(of: dict, to: dict) -> None:
    """Raises unless grid `of` covers grid `to`; y runs downwards."""
    edges = lambda g: (g["ulx"], g["ulx"] + g["cols"] * g["xres"], g["uly"] + g["rows"] * g["yres"], g["uly"])
    (x0, x1, y0, y1), (u0, u1, v0, v1) = edges(of), edges(to)
    if u0 < x0 or u1 > x1 or v0 < y0 or v1 > y1:
        raise ValueError("the correction grid does not cover the band")
