"""Footprint geometry: points in polygons, zones, boxes, clipping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.operators.statistics import averages


def snapped(ring: Column) -> Column:
    """The ring with coordinates truncated to whole cells."""
    return F.transform(ring, lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a closed ring: even-odd rule, and points on an edge are inside."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        side = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        spans = (p["y"] > y) != (q["y"] > y)
        return spans & F.when(q["y"] > p["y"], side > 0).otherwise(side < 0)

    def on_edge(e: Column) -> Column:
        p, q = e["p"], e["q"]
        side = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        return (side == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(
            F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
        )

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def box_of(ring: Column) -> dict[str, Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(x), "xmax": F.array_max(x), "ymin": F.array_min(y), "ymax": F.array_max(y)}


def zones(cells: DataFrame, rings: DataFrame, most: int = 100_000, block: int = 64) -> DataFrame:
    """cells with det_id, the highest detector whose ring holds the cell; others have no row.

    Cells and rings meet on the blocks of `block` by `block` cells that the rings'
    boxes touch, all rings of a block in one row, so that each cell stays one row
    and nothing is aggregated. The blocks are broadcast if they hold at most
    `most` points of rings in all, else they are shuffled.
    """
    rings = rings.select("det_id", snapped(F.col("ring")).alias("ring"))
    box = box_of(F.col("ring"))
    at = lambda x: F.floor(x / block).cast("int")
    tiled = rings.withColumn("_br", F.explode(F.sequence(at(box["ymin"]), at(box["ymax"])))).withColumn("_bc", F.explode(F.sequence(at(box["xmin"]), at(box["xmax"]))))
    points = tiled.agg(F.sum(F.size("ring"))).first()[0] or 0
    held = tiled.groupBy("_br", "_bc").agg(F.collect_list(F.struct("det_id", "ring")).alias("_rings"))
    placed = cells.withColumns({"_br": at(F.col("r")), "_bc": at(F.col("c"))})
    met = placed.join(F.broadcast(held) if points <= most else held, ["_br", "_bc"])
    inside = F.filter("_rings", lambda d: contains(d["ring"], F.col("c"), F.col("r")))
    found = F.array_max(F.transform(inside, lambda d: d["det_id"]))
    return met.withColumn("det_id", found).where("det_id is not null").select(*cells.columns, "det_id")


def nearest(cells: DataFrame, points: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """The n nearest points (det_id, i, x, y) of each cell (r, c), with rn from 1; ties by det_id, then i.

    A cell keeps the best n of the points of a part in one array, so that cells
    are neither multiplied nor sorted. Points are few as a rule (the vertices of
    footprints); more of them meet the cells part by part, and the bests of all
    parts are merged by an aggregate.
    """
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "det_id", F.col("i").cast("int").alias("i"))
    count = points.count()
    parts = points.select(F.pmod(F.xxhash64("det_id", "i"), F.lit(max(1, -(-count // most)))).alias("part"), point.alias("p"))
    parts = parts.groupBy("part").agg(F.collect_list("p").alias("ps"))  # arrays of about `most` points
    away = lambda p: (p["x"] - F.col("c")) * (p["x"] - F.col("c")) + (p["y"] - F.col("r")) * (p["y"] - F.col("r"))
    seen = F.transform("ps", lambda p: F.struct(away(p).alias("d"), p["det_id"].alias("det_id"), p["i"].alias("i")))
    if count <= most:  # one row of a counted size
        found = cells.join(F.broadcast(parts)).select("r", "c", F.slice(F.array_sort(seen), 1, n).alias("best"))
    else:
        met = cells.join(parts).select("r", "c", F.slice(F.array_sort(seen), 1, n).alias("best"))
        found = met.groupBy("r", "c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, n).alias("best"))
    return found.select("r", "c", F.posexplode("best").alias("_rn", "_b")).select("r", "c", "_b.det_id", "_b.i", (F.col("_rn") + 1).alias("rn"))


def mid_points(ring: Column, descending: bool = False) -> Column:
    """The middles x, y of a closed ring's edges by y, then x; or the other way round."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    middle = lambda e, k: (e["p"][k] + e["q"][k]) / 2
    by_y = F.array_sort(F.transform(pairs, lambda e: F.struct(middle(e, "y").alias("y"), middle(e, "x").alias("x"))))
    return F.transform(F.reverse(by_y) if descending else by_y, lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y")))


def outline(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """The cells that any of the rings holds: the union of footprints on the grid."""
    return zones(cells, rings).drop("det_id")


def outline_intersection(cells: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells that both sets of rings hold."""
    return outline(outline(cells, a), b)


def extent(rings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """xmin, xmax, ymin, ymax of all rings, by key."""
    box = rings.select(*keys, *[v.alias(k) for k, v in box_of(F.col("ring")).items()])
    return box.groupBy(*keys).agg(*[(F.min if k.endswith("min") else F.max)(k).alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


def affine(ring: Column, m: Sequence[float]) -> Column:
    """The ring under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5: a stand-in for a change of projection."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return F.transform(ring, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def zone_statistics(cells: DataFrame, option: str, value: str = "v", clip: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Average (mean, median or mode of 3 decimals, the smallest of equals) and deviation by keys and det_id."""
    if clip is not None:
        cells = cells.where(F.abs(F.col(value)) <= clip)
    by = [*keys, "det_id"]
    found = averages(cells, by, value, option).withColumnRenamed("m", "average")
    rest = cells.groupBy(*by).agg(F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return found.join(rest, by)


def clip(cells: DataFrame, ring: Sequence[tuple[float, float]], value: str = "v", no_data: float = -9999) -> DataFrame:
    """Cells in the box of a ring, with no_data outside the ring."""
    points = F.array(*[F.struct(F.lit(round(x)).alias("x"), F.lit(round(y)).alias("y")) for x, y in ring])
    xs, ys = [round(x) for x, _ in ring], [round(y) for _, y in ring]
    inside = cells.where(F.col("c").between(min(xs), max(xs)) & F.col("r").between(min(ys), max(ys)))
    return inside.withColumn(value, F.when(contains(points, F.col("c"), F.col("r")), F.coalesce(F.col(value), F.lit(no_data))).otherwise(F.lit(no_data)))


def burn(cells: DataFrame, ring: Sequence[tuple[float, float]], value: str = "mask", add: int = 255) -> DataFrame:
    """cells with `value` set to add inside the ring."""
    points = F.array(*[F.struct(F.lit(int(x)).alias("x"), F.lit(int(y)).alias("y")) for x, y in ring])
    return cells.withColumn(value, F.when(contains(points, F.col("c"), F.col("r")), F.lit(add)).otherwise(F.col(value)))


def edges(rings: DataFrame, key: str = "det_id") -> DataFrame:
    """The edges of rings: key, i, x1, y1, x2, y2."""
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))
    return rings.select(key, F.posexplode(pairs).alias("i", "e")).select(
        key, "i", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")
    )


def stripe_angle(rings: DataFrame, tol: float = 0.5) -> DataFrame:
    """Mean and deviation of the angles of all edges but the upright and level ones."""
    from orthoflow.functions.raster import edge_angle

    a = edges(rings).select(edge_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("angle"))
    kept = a.where(~F.col("angle").between(90 - tol, 90 + tol) & ~F.col("angle").between(-tol, tol))
    return kept.agg(F.avg("angle").alias("mean"), F.stddev_pop("angle").alias("std"), F.count(F.lit(1)).alias("n"))


def clip_convex(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one (open rings, any direction), as an open ring."""
    area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(window, [*window[1:], window[0]]))
    window = window if area > 0 else window[::-1]
    out = subject
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        got: list[tuple[float, float]] = []
        for p, q in zip(out, [*out[1:], *out[:1]]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                got.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                got.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = got
    return out


def _corners(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings of points x, y as columns: x and y (corner by ring, then the first corner again to the end) and the corners of each."""
    flat, sizes = rings.flatten(), np.diff(rings.offsets.to_numpy())
    n, first = np.maximum(sizes - 1, 0), np.cumsum(sizes) - sizes
    corner = np.arange(n.max(initial=0) + 1)[:, None]
    at = np.where(corner < n, first + corner, first)
    x, y = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
    return (x[at], y[at], n) if len(flat) else (np.zeros(at.shape), np.zeros(at.shape), n)


def _turned(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of _corners(), all of them in the positive direction."""
    turns = sum((x[k] * y[k + 1] - x[k + 1] * y[k] for k in range(len(x) - 1)), np.zeros(x.shape[1]))
    corner = np.arange(len(x))[:, None]
    at = np.where(turns > 0, corner, np.where(corner < n, n - 1 - corner, np.maximum(n - 1, 0)))
    return np.take_along_axis(x, at, 0), np.take_along_axis(y, at, 0)


def clip_many(x: np.ndarray, y: np.ndarray, n: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """clip_convex() of many pairs at once: polygon k of _corners() is held by window k of _turned()."""
    x, y, n = x.copy(), y.copy(), n.copy()
    for k in range(len(wx) - 1):
        ax, ay, bx, by = wx[k], wy[k], wx[k + 1], wy[k + 1]
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        cut = np.flatnonzero((side < 0).any(axis=0) & (n > 0))  # all others stay whole
        if not len(cut):
            continue
        p, q, side, m = x[:, cut], y[:, cut], side[:, cut], n[cut]
        inside, own = side >= 0, np.arange(len(p) - 1)[:, None] < m
        crossed = (inside[:-1] != inside[1:]) & own
        with np.errstate(divide="ignore", invalid="ignore"):
            t = side[:-1] / (side[:-1] - side[1:])
        kept = np.stack([inside[:-1] & own, crossed], axis=1).reshape(-1, len(cut))
        place = np.cumsum(kept, axis=0) - 1
        m = place[-1] + 1
        old, ring = np.nonzero(kept)
        to = place[old, ring]
        grown = max(0, m.max(initial=0) + 1 - len(x))
        x, y = (np.concatenate([v, np.broadcast_to(v[0], (grown, v.shape[1]))]) if grown else v for v in (x, y))
        for all_, v in ((x, p), (y, q)):
            with np.errstate(invalid="ignore"):
                both = np.stack([v[:-1], v[:-1] + t * (v[1:] - v[:-1])], axis=1).reshape(-1, len(cut))
            got = np.zeros((len(x), len(cut)))
            got[to, ring] = both[old, ring]
            all_[:, cut] = np.where(np.arange(len(x))[:, None] < m, got, got[0])
        n[cut] = m
    return x, y, n


def areas_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of the columns of _corners()."""
    total = np.zeros(x.shape[1])
    for k in range(len(x) - 1):
        total = total + x[k] * y[k + 1] - x[k + 1] * y[k]
    return np.abs(total) / 2


def intersections(pairs: DataFrame) -> DataFrame:
    """pairs (id_a, ring_a, id_b, ring_b; b convex, rings closed) with `ring`, their closed intersection; empty ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = clip_many(*_corners(batch.column(1)), *_turned(*_corners(batch.column(3))))
            left = np.flatnonzero(n > 2)
            held = (np.arange(len(x))[:, None] <= n[left]).T
            points = pa.StructArray.from_arrays([x[:, left].T[held], y[:, left].T[held]], ["x", "y"])
            rings = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[left] + 1)], pa.int32()), points)
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), rings], ["id_a", "id_b", "ring"])

    return pairs.select("id_a", "ring_a", "id_b", "ring_b").mapInArrow(run, "id_a int, id_b int, ring array<struct<x:double,y:double>>")


def intersection_areas(rings: DataFrame, keys: Sequence[str] = ("nation",), id: str = "det_id", most: int = 256, at_once: int = 8192) -> DataFrame:
    """Areas of the intersections of all pairs of rings (keys, id int, ring closed and convex) of equal keys: id_a < id_b, area; empty ones go.

    Rings are dealt to parts of about `most`, and a row holds two parts of a
    group, so rings are copied once a part, not once a pair. Pairs are made
    beside the arrays, `at_once` at a time, and those whose boxes meet are clipped.
    """
    rings = rings.select(*keys, F.col(id).cast("int").alias("id"), "ring").dropna()
    sizes = rings.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    rows = sizes.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2)).first()[0] or 0
    dealt = rings.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    blocks = dealt.groupBy(*keys, "part").agg(F.collect_list("id").alias("ids"), F.collect_list("ring").alias("rings"))
    side = lambda s: blocks.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("part", "ids", "rings")])
    met = side("a").join(side("b"), list(keys)).where("part_a <= part_b")
    tasks = max(4 * rings.sparkSession.sparkContext.defaultParallelism, int(rows) // 16)
    met = met.repartition(tasks, *keys, "part_a", "part_b").select("ids_a", "rings_a", "ids_b", "rings_b", (F.col("part_a") == F.col("part_b")).alias("same"))

    def of(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        one = batch.slice(row, 1)
        ids = np.concatenate([one.column(k).flatten().to_numpy() for k in (0, 2)])
        x, y, n = _corners(pa.concat_arrays([one.column(1).flatten(), one.column(3).flatten()]))
        wx, wy = _turned(x, y, n)
        box = x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0)
        mid, same = len(one.column(0).flatten()), one.column(4)[0].as_py()
        rows = max(1, at_once // max(1, len(ids) - mid))
        for start in range(0, mid, rows):
            a, b = (g.ravel() for g in np.meshgrid(np.arange(start, min(mid, start + rows)), np.arange(mid, len(ids)), indexing="ij"))
            a, b = (a, b) if same else (np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a))
            meet = (ids[a] < ids[b]) & (box[0][a] <= box[1][b]) & (box[0][b] <= box[1][a]) & (box[2][a] <= box[3][b]) & (box[2][b] <= box[3][a])
            a, b = a[meet], b[meet]
            cx, cy, cn = clip_many(x[:, a], y[:, a], n[a], wx[:, b], wy[:, b])
            left = cn > 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[left]]), pa.array(ids[b[left]]), pa.array(areas_of(cx[:, left], cy[:, left]))], ["id_a", "id_b", "area"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from of(batch, row)

    return met.mapInArrow(run, "id_a int, id_b int, area double")


def area(ring: Column) -> Column:
    """Area of a closed ring."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def mid_lines(granule: list[tuple[int, list[tuple[float, float]]]]) -> list[tuple[int, list[tuple[float, float]]]]:
    """Abutting rings of overlapping neighbours, for detectors in order: (det_id, closed ring).

    The right border of a ring is its run of vertices from the one with the
    largest x downwards, the left border of the next from the smallest x upwards;
    both are joined in the middle of the overlap, by height.
    """

    def at(border: list[tuple[float, float]], y: float) -> float:
        border = sorted(border, key=lambda p: p[1])
        if y <= border[0][1]:
            return border[0][0]
        for (x1, y1), (x2, y2) in zip(border, border[1:]):
            if y1 <= y <= y2:
                return x1 if y2 == y1 else x1 + (x2 - x1) * (y - y1) / (y2 - y1)
        return border[-1][0]

    def sides(ring: list[tuple[float, float]]) -> tuple[list, list]:
        points = sorted(set(ring), key=lambda p: (p[1], p[0]))
        heights = sorted({y for _, y in points})
        left = [(min(x for x, v in points if v == y), y) for y in (heights[0], heights[-1])]
        right = [(max(x for x, v in points if v == y), y) for y in (heights[0], heights[-1])]
        middle = sum(x for x, _ in points) / len(points)
        inner = [p for p in points if heights[0] < p[1] < heights[-1]]
        left += [p for p in inner if p[0] < middle]
        right += [p for p in inner if p[0] >= middle]
        return sorted(left, key=lambda p: p[1]), sorted(right, key=lambda p: p[1])

    ordered = [(k, *sides(ring)) for k, ring in sorted(granule)]
    borders = []
    for (_, _, right), (_, left, _) in zip(ordered, ordered[1:]):
        heights = sorted({y for _, y in right} | {y for _, y in left})
        borders.append([((at(right, y) + at(left, y)) / 2, y) for y in heights])
    out = []
    for i, (k, left, right) in enumerate(ordered):
        start = borders[i - 1] if i else left
        end = borders[i] if i < len(borders) else right
        out.append((k, [*start, *reversed(end), start[0]]))
    return out


def resolve_footprints(footprints: DataFrame) -> DataFrame:
    """Abutting footprints by granule (granule, sensed date, det_id, ring); from 2018-11-06 on rings stay as they are."""
    import pandas as pd

    schema = "granule string, sensed date, det_id int, ring array<struct<x:double,y:double>>"
    new = footprints.where(F.col("sensed") >= F.lit("2018-11-06").cast("date")).select("granule", "sensed", "det_id", "ring")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rings = [(int(k), [(p["x"], p["y"]) for p in ring]) for k, ring in zip(group["det_id"], group["ring"])]
        done = mid_lines(rings)
        return pd.DataFrame(
            [(group["granule"].iloc[0], group["sensed"].iloc[0], k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in done],
            columns=["granule", "sensed", "det_id", "ring"],
        )

    old = footprints.where(F.col("sensed") < F.lit("2018-11-06").cast("date"))
    return old.groupBy("granule").applyInPandas(run, schema).unionByName(new)
