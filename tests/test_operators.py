"""Operators against results worked out by hand or by brute force in NumPy."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.functions import templates as T
from orthoflow.operators import correction, geometry, gridding, masks, pairing, statistics, windows
from orthoflow.sources import rasters, scenes


def pixels(spark, a, name="v", kind="double"):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"r int, c int, {name} double").withColumn(name, F.col(name).cast(kind))


def image(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row["r"], row["c"]] = np.nan if row[name] is None else row[name]
    return out


def window_of(a, i, j, p):
    return a[max(0, i - p) : i + p + 1, max(0, j - p) : j + p + 1]


def test_coherence_is_that_of_brute_force(spark):
    rng = np.random.default_rng(1)
    n, rows, cols = 3, 6, 7
    ew, ns, cc = (rng.integers(-5, 6, (n, rows, cols)), rng.integers(-5, 6, (n, rows, cols)), rng.integers(0, 256, (n, rows, cols)))
    data = [(int(i), int(j), k, int(ew[k, i, j]), int(ns[k, i, j]), int(cc[k, i, j])) for k in range(n) for i in range(rows) for j in range(cols)]
    stack = spark.createDataFrame(data, "r int, c int, k int, ew int, ns int, cc int")
    p = windows.StackParameters(window=3, min_cc=-0.5)
    low = (cc - 128) / 127.0 < p.min_cc
    e, s, na = np.where(low, 0, ew).sum(0), np.where(low, 0, ns).sum(0), low.sum(0)
    path = np.hypot(np.where(low, 0, ew), np.where(low, 0, ns)).sum(0)
    want = np.zeros((rows, cols))
    for i in range(rows):
        for j in range(cols):
            used = n - na[i, j]
            if used and np.hypot(e[i, j] / used, s[i, j] / used) > p.min_displacement and na[i, j] <= n * (1 - p.min_matches):
                if not window_of(na, i, j, 1).sum() > 9 * n * p.min_matches:
                    want[i, j] = np.hypot(window_of(e, i, j, 1).sum(), window_of(s, i, j, 1).sum()) / window_of(path, i, j, 1).sum()
    got = image(windows.vector_coherence(stack, p, n, rows, cols), (rows, cols), "vc")
    assert np.allclose(got, want) and (want > 0).any() and got.max() <= 1 + 1e-9


def test_constant_field_is_coherent(spark):
    stack = spark.createDataFrame([(i, j, 1, 3, 4, 255) for i in range(5) for j in range(5)], "r int, c int, k int, ew int, ns int, cc int")
    got = windows.vector_coherence(stack, windows.StackParameters(window=3), 1, 5, 5)
    assert {round(r["vc"], 9) for r in got.collect()} == {1.0}


def test_all_masked_pixels_are_not_processed(spark):
    stack = spark.createDataFrame([(0, 0, 1, 3, 4, 0), (0, 0, 2, 3, 4, 0)], "r int, c int, k int, ew int, ns int, cc int")
    assert windows.mean_magnitude(windows.pixel_sums(stack, 0.3), 2).first()["mean_magn"] is None
    assert windows.vector_coherence(stack, windows.StackParameters(window=3), 2, 1, 1).first()["vc"] == 0.0


@pytest.mark.parametrize("bad", [{"window": 4}, {"min_matches": 1.5}])
def test_stack_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        windows.StackParameters(**bad)


def test_box_filters(spark):
    a = np.arange(30, dtype=float).reshape(5, 6) ** 1.5
    a[2, 3] = np.nan
    df = pixels(spark, a)
    mean = image(windows.block_mean(df, "v", 1), a.shape, "filtered")
    median = image(windows.block_median(df, "v", 1), a.shape, "filtered")
    for i in range(5):
        for j in range(6):
            w = window_of(a, i, j, 1)
            assert np.isclose(mean[i, j], np.nanmean(w)) and np.isclose(median[i, j], np.nanmedian(w))


def test_morphology(spark):
    a = np.zeros((7, 7))
    a[2:5, 2:5] = 1
    a[3, 3] = 0
    closed = image(windows.close_open(pixels(spark, a, kind="int"), 1, None), a.shape)
    assert closed[3, 3] == 1 and closed.sum() == 9
    a[0, 6] = 1
    opened = image(windows.close_open(pixels(spark, a, kind="int"), None, 1), a.shape)
    assert opened[0, 6] == 0
    with pytest.raises(ValueError):
        windows.close_open(pixels(spark, a), None, None)


@pytest.mark.parametrize("radii", [(0, 0), (1, 1), (3, 3), (7, 4), (20, 20), (0, 5)])
def test_boxes_cover_just_the_disk(radii):
    covered = {(i, j) for a, b in windows.disk_boxes(*radii) for i in range(-a, a + 1) for j in range(-b, b + 1)}
    assert covered == set(windows.disk(*radii))


def test_morphology_of_holes_and_tiles(spark):
    rng = np.random.default_rng(8)
    cells = [(t, r, c, None if rng.random() < 0.2 else int(rng.integers(9))) for t in (1, 2) for r in range(9) for c in range(8) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "tile int, r int, c int, v int")
    now = {(t, r, c): v for t, r, c, v in cells}
    for pick, n in ((max, 2), (min, 2), (min, 3), (max, 3)):
        balls = windows.disk(n, n)
        around = {k: [now.get((k[0], k[1] + a, k[2] + b)) for a, b in balls] for k in now}
        now = {k: pick((x for x in found if x is not None), default=None) for k, found in around.items()}
    got = windows.close_open(df, 20, 30, resolution=10, keys=["tile"]).collect()
    assert {(x["tile"], x["r"], x["c"]): x["v"] for x in got} == now


def test_median_of_holes_and_layers(spark):
    rng = np.random.default_rng(9)
    rows = [(r, c, None if rng.random() < 0.3 else float(rng.integers(50))) for r in range(7) for c in range(7) for _ in range(3) if rng.random() < 0.5]
    got = windows.block_median(spark.createDataFrame(rows, "r int, c int, v double"), "v", 1).collect()
    assert {(x["r"], x["c"]) for x in got} == {(r, c) for r, c, _ in rows}
    for x in got:
        near = [v for r, c, v in rows if v is not None and abs(r - x["r"]) < 2 and abs(c - x["c"]) < 2]
        assert x["filtered"] == (float(np.median(near)) if near else None)


def test_denoise_keeps_flat_tiles_and_range(spark):
    rng = np.random.default_rng(2)
    noisy = rng.normal(size=(8, 8)).tolist()
    df = spark.createDataFrame([(1, [[3.0] * 8] * 8), (2, noisy)], "tile long, data array<array<double>>")
    got = {r["tile"]: np.array(r["data"]) for r in windows.denoise_tiles(df, "tile", search=5, patch=3).collect()}
    assert np.allclose(got[1], 3.0)
    x = np.array(noisy)
    low, high = x.min(), x.max()
    y = np.pad((x - low) / (high - low) * 255, 3, mode="reflect")
    want = np.zeros((8, 8))
    for i in range(8):
        for j in range(8):
            ws, total = 0.0, 0.0
            for dr in range(-2, 3):
                for dc in range(-2, 3):
                    a, b = y[i + 2 : i + 5, j + 2 : j + 5], y[i + 2 + dr : i + 5 + dr, j + 2 + dc : j + 5 + dc]
                    w = np.exp(-((a - b) ** 2).mean() / 4)
                    ws, total = ws + w, total + w * y[i + 3 + dr, j + 3 + dc]
            want[i, j] = total / ws
    assert np.allclose(got[2], want / 255 * (high - low) + low)


def test_plane_of_a_plane_and_outliers(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(-1, 1, (60, 2))
    rows = [(float(x), float(y), float(2 * x - 3 * y + 5)) for x, y in xy]
    p = statistics.fit_plane(spark.createDataFrame(rows, "x double, y double, z double"))
    assert np.allclose([p.a, p.b, p.c], [2, -3, 5]) and len(p.trace) == 1
    noisy = [(x, y, z + (30 if i % 10 == 0 else 0) + float(rng.normal(0, 0.01))) for i, (x, y, z) in enumerate(rows)]
    noisy.append((0.0, 0.0, None))
    q = statistics.fit_plane(spark.createDataFrame(noisy, "x double, y double, z double"), iterations=5)
    assert np.allclose([q.a, q.b, q.c], [2, -3, 5], atol=0.05) and len(q.trace) == 6

    z = np.array([r[2] for r in noisy[:-1]])
    X = np.c_[xy, np.ones(60)]
    beta = np.linalg.lstsq(X, z, rcond=None)[0]
    for _ in range(5):
        r = np.abs(X @ beta - z)
        u = r / (statistics.TUNE * np.median(r))
        w = np.where((u > 1) | (u == 0), 0, (1 - u**2) ** 2)
        beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * z))
    assert np.allclose([q.a, q.b, q.c], beta)


def test_plane_without_values_is_an_error(spark):
    with pytest.raises(ValueError):
        statistics.fit_plane(spark.createDataFrame([(0.0, 0.0, None)], "x double, y double, z double"))


@pytest.mark.parametrize("values", [
    [], [None], [3.0], [1.0, 2.0], list(np.random.default_rng(8).normal(size=501)), list(np.random.default_rng(9).normal(size=500)),
    [1.0] * 300 + [2.0] * 300, [1.0] * 301 + [2.0] * 299, [5.0] * 400, list(np.random.default_rng(10).integers(0, 3, 777)), [0.0] * 10 + list(range(1, 400)),
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    want = np.median([v for v in values if v is not None]) if any(v is not None for v in values) else None
    for most in (5, 100_000):
        assert statistics.exact_median(df, F.col("v"), most) == want


def test_clip(spark):
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(0, 1, 500), [50, -60, 80]]
    g = statistics.gaussian_clip(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v")
    mu, sigma, kept, low, high = v.mean(), v.std(), v, -np.inf, np.inf
    while True:
        low, high = max(low, mu - 2.575 * sigma), min(high, mu + 2.575 * sigma)
        kept, before = v[(v > low) & (v < high)], sigma
        mu, sigma = kept.mean(), kept.std()
        if before - sigma < 0.005:
            break
    assert np.isclose(g.mu, mu) and np.isclose(g.sigma, sigma) and g.n == len(kept)
    empty = statistics.gaussian_clip(spark.createDataFrame([(None,)], "v double"), "v")
    assert empty.n == 0 and empty.mu is None


def test_zoom_in_matches_replicated_cubic(spark):
    a = np.random.default_rng(5).normal(size=(4, 4))
    got = image(gridding.zoom_in(pixels(spark, a), 2, 4, 4), (8, 8), "got")

    def k(x, A=-0.75):
        x = abs(x)
        return (A + 2) * x**3 - (A + 3) * x**2 + 1 if x <= 1 else A * x**3 - 5 * A * x**2 + 8 * A * x - 4 * A if x < 2 else 0

    for i in range(8):
        for j in range(8):
            y, x = (i + 0.5) / 2 - 0.5, (j + 0.5) / 2 - 0.5
            fy, fx = int(np.floor(y)), int(np.floor(x))
            want = sum(
                k(y - r) * k(x - c) * a[min(max(r, 0), 3), min(max(c, 0), 3)] for r in range(fy - 1, fy + 3) for c in range(fx - 1, fx + 3)
            )
            assert np.isclose(got[i, j], want)


def test_rotation_by_nothing_and_a_quarter(spark):
    a = np.arange(16, dtype=float).reshape(4, 4)
    df = pixels(spark, a)
    assert np.array_equal(image(gridding.rotate(df, 4, 4, 0), (4, 4), "got"), a)
    turn = gridding.rotation(4, 4, 90)
    assert (turn.rows, turn.cols) == (4, 4)


def test_destriping_of_pure_stripes_leaves_nothing(spark):
    a = np.tile(np.array([1.0, -2.0, 4.0, 0.5, 3.0]), (6, 1))
    got = gridding.destripe(pixels(spark, a), 6, 5, 0)
    assert np.allclose(image(got, a.shape), 0)


def test_remap_by_whole_pixels(spark):
    a = np.arange(20, dtype=float).reshape(4, 5) * 100
    src = pixels(spark, a)
    shifts = src.select("r", "c", F.lit(1.0).alias("px"), F.lit(0.0).alias("py"))
    want = np.c_[a[:, 1:], np.zeros(4)]
    assert np.array_equal(image(gridding.remap(src, shifts), a.shape), want)
    assert np.array_equal(image(gridding.remap(src, shifts, nearest=True), a.shape), want)


def test_scalars(spark):
    row = spark.range(1).select(
        R.uint16(F.lit(-1.0)).alias("wrap"), R.uint16(F.lit(2.5)).alias("even"), R.map_to_pixel(F.lit(-5.0), 0, 10).alias("toward_zero"),
        R.cc_python(F.lit(100)).alias("py"), R.cc_stack(F.lit(1)).alias("stack"), R.mask_large(F.lit(5), -4).alias("large"),
        R.intersection(R.line(*[F.lit(x) for x in (0.0, 0.0, 2.0, 2.0)]), R.line(*[F.lit(x) for x in (0.0, 2.0, 2.0, 0.0)])).alias("cross"),
        R.intersection(R.line(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)]), R.line(*[F.lit(x) for x in (0.0, 1.0, 1.0, 2.0)])).alias("parallel"),
        R.project(*[F.lit(x) for x in (1.0, 5.0, 0.0, 0.0, 4.0, 0.0)]).alias("foot"), R.project(*[F.lit(1.0)] * 6).alias("point"),
        R.stretch(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("flat"),
    ).first()
    assert (row["wrap"], row["even"], row["toward_zero"], row["large"], row["flat"]) == (65535, 2, 0, None, 0)
    assert np.isclose(row["py"], -27 / 128) and np.isclose(row["stack"], -1)
    assert (row["cross"]["x"], row["cross"]["y"]) == (1, 1) and row["parallel"] is None
    assert (row["foot"]["x"], row["foot"]["y"]) == (1, 0) and row["point"] is None
    with pytest.raises(ValueError):
        R.mask_low_cc_raw(F.lit(1), F.lit(1), 1.0)


def test_two_dates_and_wkt(spark):
    row = spark.range(1).select(
        R.two_dates(F.lit("p_201206071034251_x_201210051030181")).alias("d"), R.two_dates(F.lit("other")).alias("none"),
        R.wkt(F.array(F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("w"),
    ).first()
    assert (str(row["d"]["date1"]), str(row["d"]["date2"])) == ("2012-06-07", "2012-10-05")
    assert row["none"] is None and row["w"] == "POLYGON ((0 1))"


def test_masks(spark):
    c = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 4)], "r int, c int, cls int")
    assert masks.cloud_cover(c).first()["covered"] == pytest.approx(2 / 3)
    assert [r["mask"] for r in masks.combine_masks(c, c).orderBy("r", "c").collect()] == [255, 0, 0, 0]
    assert masks.cloud_cover(c.where("cls = 0")).first()["covered"] is None


def test_pairs(spark):
    days = [datetime.date(2018, 1, d) for d in (1, 5, 9, 20)]
    s = spark.createDataFrame([(f"s{i}", d) for i, d in enumerate(days)], "scene_id string, date date")
    seq = pairing.flat(pairing.sequence_pairs(s, 2))
    got = {(r["ref_id"], r["sec_id"]) for r in seq.collect()}
    ahead = {("s0", "s1"), ("s1", "s2"), ("s2", "s3"), ("s0", "s2"), ("s1", "s3")}
    assert got == ahead | {(b, a) for a, b in ahead}
    assert pairing.forward_backward(pairing.sequence_pairs(s, 2)).count() == 5
    assert pairing.forward_backward(pairing.sequence_pairs(s, 2, backward=False)).count() == 0
    assert pairing.star_pairs(s, F.lit(days[1])).count() == 3
    with pytest.raises(Exception, match="no single scene"):
        pairing.star_pairs(s, F.lit(datetime.date(2000, 1, 1))).collect()
    assert pairing.before_after_pairs(s, F.lit(days[2])).count() == 4
    assert pairing.series_bounds(pairing.flat(pairing.sequence_pairs(s))).first()["days"] == 19


def test_pairs_by_date_take_all_scenes(spark):
    from orthoflow.plans import QUERIES
    from orthoflow.plans.fixtures import scenes

    sf = "/root/testdata/sf0.001"
    dates = [r["date"] for r in scenes(spark, sf).collect()]
    split = datetime.date(1998, 1, 1)
    early = sum(d < split for d in dates)
    assert QUERIES["pairs_star_by_date"](spark, sf).count() == len(dates) - 1
    assert QUERIES["pairs_before_after"](spark, sf).count() == 2 * early * (len(dates) - early)


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]])
    pts = spark.createDataFrame([(2, 2), (4, 2), (0, 0), (5, 2), (-1, 0)], "c int, r int")
    got = [r["i"] for r in pts.select(geometry.contains(ring, F.col("c"), F.col("r")).alias("i")).collect()]
    assert got == [True, True, True, False, False]
    assert len(geometry.clip_convex([(0, 0), (4, 0), (4, 4), (0, 4)], [(10, 10), (12, 10), (12, 12)])) == 0
    inside = geometry.clip_convex([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)])
    assert sorted(inside) == [(2, 2), (2, 4), (4, 2), (4, 4)]
    with pytest.raises(ValueError):
        geometry.zone_statistics(pts, "most")


def test_many_rings_take_the_shuffled_way(spark):
    rings = spark.createDataFrame([(k, [(0.0, 0.0), (70.0, 0.0), (70.0, 70.0 + k), (0.0, 70.0), (0.0, 0.0)]) for k in (1, 2)], "det_id int, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(i, i) for i in range(0, 90, 7)], "r int, c int")
    a, b = geometry.zones(cells, rings), geometry.zones(cells, rings, most=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 11


def test_footprints(spark):
    left = [{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 10.0}, {"x": 0.0, "y": 10.0}, {"x": 0.0, "y": 0.0}]
    right = [{"x": 4.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 10.0}, {"x": 4.0, "y": 10.0}, {"x": 4.0, "y": 0.0}]
    old, new = datetime.date(2017, 1, 1), datetime.date(2019, 1, 1)
    df = spark.createDataFrame([("a", old, 1, left), ("a", old, 2, right), ("b", new, 1, left)], "granule string, sensed date, det_id int, ring array<struct<x:double,y:double>>")
    got = {(r["granule"], r["det_id"]): {(p["x"], p["y"]) for p in r["ring"]} for r in geometry.resolve_footprints(df).collect()}
    assert got["a", 1] == {(0, 0), (5, 0), (5, 10), (0, 10)} and got["a", 2] == {(5, 0), (9, 0), (9, 10), (5, 10)}
    assert got["b", 1] == {(0, 0), (6, 0), (6, 10), (0, 10)}


def test_correction_takes_off_plane_and_detectors(spark):
    rows = cols = 32
    i, j = np.mgrid[0:rows, 0:cols]
    a = 0.5 + 0.02 * j - 0.01 * i + np.where(j < 16, 1.0, -1.0) * 0
    field = pixels(spark, a).withColumn("cc", F.lit(250))
    p = correction.CorrectionParameters(rows, cols)
    found = correction.estimate(field, None, p)
    assert np.allclose(image(correction.apply(field, found, None, p), a.shape), 0, atol=1e-6)
    assert {r["stage"] for r in found.log.collect()} == {"input", "plane_corrected"}
    both = field.select(F.lit(1).alias("pair"), "r", "c", F.col("v").alias("px1"), (-F.col("v")).alias("px2"), "cc")
    done = correction.correct_all(both, "pair", None, p)
    for axis in ("px1", "px2"):
        assert np.allclose(image(done.fields.withColumn("v", F.col(axis)), a.shape), 0, atol=1e-6)


def test_all_pairs_are_corrected_like_one(spark):
    from orthoflow.plans import QUERIES, correction as plans
    from orthoflow.plans.fixtures import grid, rings

    sf = "/root/testdata/sf0.001"
    key = lambda rows: {(r["r"], r["c"]): r["v"] for r in rows}
    one = key(QUERIES["correction_pipeline"](spark, sf).collect())
    many = key(QUERIES["correct_all"](spark, sf).where("k = 1").withColumn("v", F.col("px1")).collect())
    assert one.keys() == many.keys()
    for at, v in one.items():
        assert v == many[at] or abs(v - many[at]) < 1e-5
    fields = grid(spark, sf).where("k < 3").select("k", "r", "c", F.col("ew").cast("double").alias("v"), "cc")
    found = correction.estimate_pairs(fields, "k", rings(spark), plans.P)
    want = correction.estimate(plans.field(spark, sf), rings(spark), plans.P)
    assert abs(found.sigmas.where("k = 1").first()["sigma"] - want.sigma) < 1e-6
    logs = [{r["stage"]: (r["n"], round(r["rmse"], 5)) for r in df.collect()} for df in (found.log.where("k = 1"), want.log)]
    assert logs[0] == logs[1]


def test_scene_metadata(spark):
    lines = ['    DATE_ACQUIRED = 2018-03-04', '    SCENE_CENTER_TIME = "10:20:30Z"', '    FILE_NAME_BAND_QUALITY = "X_BQA.TIF"'] + [f'    FILE_NAME_BAND_{b} = "X_B{b}.TIF"' for b in range(1, 10)]
    row = scenes.landsat_scenes(spark.createDataFrame([("p", x) for x in lines], "path string, value string")).first()
    assert (str(row["date"]), row["time"], len(row["band_paths"]), row["match_band"]) == ("2018-03-04", "10:20:30Z", 9, "X_B8.TIF")
    xml = "<a><b><PRODUCT_START_TIME>2018-03-04T10:20:30.123Z</PRODUCT_START_TIME></b></a>"
    row = scenes.sentinel_scenes(spark.createDataFrame([("p", xml)], "path string, xml string")).first()
    assert (str(row["date"]), row["time"]) == ("2018-03-04", "10:20:30.123Z")
    names = spark.createDataFrame([([f"T_{b}.jp2" for b in sorted(scenes.S2_BANDS)],)], "p array<string>")
    assert [x[2:5] for x in names.select(scenes.order_bands(F.col("p"))).first()[0]] == scenes.S2_BANDS
    assert [r[0] for r in spark.createDataFrame([("X_MTL.txt",), ("S2A_x",)], "n string").select(scenes.satellite(F.col("n"))).collect()] == ["L8", "S2"]
    with pytest.raises(Exception, match="unknown satellite"):
        spark.range(1).select(scenes.satellite(F.lit("x"))).collect()
    row = spark.range(1).select(
        scenes.sensing_date(F.lit("a_20180304T1_c_d_e_f")).alias("d"), scenes.ring_of(F.lit("1 2 3 4 5 6")).alias("ring")
    ).first()
    assert str(row["d"]) == "2018-03-04" and [(p["x"], p["y"]) for p in row["ring"]] == [(1, 2), (4, 5)]


def test_layer_listing(spark):
    base = "/x/p_201206071034251_x_201210051030181"
    same = "/x/p_201206071034251_x_201206071030181"
    files = [f"{d}/{f}" for d in (base, same) for f in ("Px1_a.tif", "Px2_a.tif", "Correl_a.tif")] + ["/x/other/Px1.tif"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    found = scenes.layers(df).collect()
    assert len(found) == 1 and found[0]["duration_days"] == 120
    assert scenes.layers(df, only_multitemporal=False, most=1).count() == 1


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    a = (np.random.default_rng(6).uniform(0, 200, (7, 9))).astype(dtype)
    (tmp_path / "a.tif").write_bytes(rasters.encode(a, (300000.0, 10.0, 0, 4900020.0, 0, -10.0)))
    got = image(rasters.read_tiff(rasters.tiff_files(spark, str(tmp_path))), a.shape)
    assert np.array_equal(got, a.astype(float))
    content = rasters.as_tiff(rasters.read_tiff(rasters.tiff_files(spark, str(tmp_path))), 7, 9, "path", dtype).first()["content"]
    assert np.array_equal(rasters.decode(bytes(content)), a)


def lzw(data):
    """A TIFF's LZW stream, written with a plain table."""
    codes, table, now, width, out = [(256, 9)], {bytes([k]): k for k in range(256)}, b"", 9, 0
    size = 258
    for k in range(len(data)):
        if now + data[k : k + 1] in table:
            now += data[k : k + 1]
            continue
        codes.append((table[now], width))
        table[now + data[k : k + 1]] = size
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        now = data[k : k + 1]
        if size == 4094:
            codes.append((table[now], width))
            codes.append((256, width))
            table, size, width, now = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if now:
        codes.append((table[now], width))
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_unpacking():
    rng = np.random.default_rng(4)
    for data in (b"aaaaaaaaabababab" * 9, bytes(rng.integers(0, 4, 3000, dtype=np.uint8)), bytes(rng.integers(0, 256, 20_000, dtype=np.uint8))):
        assert rasters.unpacked_lzw(lzw(data)) == data
    assert rasters.unpacked_bits(b"\x02abc\xfed\x80\x00e") == b"abcddde"


@pytest.mark.parametrize("compress", [False, True])
def test_windows_of_files(spark, compress):
    a = np.arange(70, dtype="int16").reshape(7, 10)
    data = rasters.encode(a, None, compress)
    assert np.array_equal(rasters.decode(data, (2, 4, 3, 99)), a[2:5, 3:])
    files = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    got = {(r["r"], r["c"]): r["v"] for r in rasters.read_tiff(files, (-5, 1, 8, 9)).collect()}
    assert got == {(r, c): a[r, c] for r in (0, 1) for c in (8, 9)}


def test_frames_are_denoised_together(spark):
    x = np.random.default_rng(5).normal(size=(3, 9, 9))
    df = spark.createDataFrame([("s", x.tolist())], "stack string, frames array<array<array<double>>>")
    got = np.array(windows.denoise_frames(df, "stack", search=3, patch=3, window=3).first()["data"])
    low, high = x.min(), x.max()
    y = [np.pad((f - low) / (high - low) * 255, 2, mode="reflect") for f in x]
    i, j = 4, 7
    own = y[1][i + 1 : i + 4, j + 1 : j + 4]
    seen = [(np.exp(-((y[k][i + 1 + a : i + 4 + a, j + 1 + b : j + 4 + b] - own) ** 2).mean() / 4), y[k][i + 2 + a, j + 2 + b]) for k in range(3) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    want = sum(w * v for w, v in seen) / sum(w for w, _ in seen) / 255 * (high - low) + low
    assert abs(got[i, j] - want) < 1e-9
    with pytest.raises(ValueError):
        windows.denoise_frames(df, "stack", window=2)


def test_bands_beyond_the_grid_are_refused(spark):
    from orthoflow.plans import correction as plans

    offsets = spark.createDataFrame([(0, 0, 1.0, 0.0)], "r int, c int, px1 double, px2 double")
    band = spark.createDataFrame([(0, 0, 5)], "r int, c int, v int")
    with pytest.raises(ValueError, match="cover"):
        correction.correct_bands({"b": (band, plans.BASE | {"cols": 65})}, offsets, plans.BASE)


def test_many_rings_are_shuffled_without_loss(spark):
    rng = np.random.default_rng(3)
    boxes = [(k, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate(rng.integers(0, 150, (40, 4)).tolist())]
    rings = spark.createDataFrame(
        [(k, [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d)), (float(a), float(b))]) for k, a, b, c, d in boxes],
        "det_id int, ring array<struct<x:double,y:double>>",
    )
    cells = spark.range(300).select(F.col("id").cast("int").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(299), F.lit(7))))
    want = {(r, c): max((k for k, x0, y0, x1, y1 in boxes if x0 <= c <= x1 and y0 <= r <= y1), default=None) for r in range(300) for c in range(0, 300, 7)}
    for most in (10**6, 1):
        got = {(x["r"], x["c"]): x["det_id"] for x in geometry.zones(cells, rings, most).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}
    points = spark.createDataFrame([(k, 0, float(a), float(b)) for k, a, b, _, _ in boxes], "det_id int, i int, x double, y double")
    few = cells.where("r < 9")
    assert sorted(map(tuple, geometry.nearest(few, points, 3, 5).collect())) == sorted(map(tuple, geometry.nearest(few, points, 3).collect()))


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        rasters.decode(b"PNG.....")


def test_pixel_tables(spark, tmp_path):
    a = np.arange(12, dtype=float).reshape(3, 4)
    a[0, 0] = np.nan
    rasters.write_pixels(pixels(spark, a), str(tmp_path / "p"))
    got = rasters.read_pixels(spark, str(tmp_path / "p"), (0, 1, 0, 1))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 4.0), (1, 1, 5.0)]
    assert "PushedFilters: [IsNotNull(r)" in got._jdf.queryExecution().toString() or "PushedFilters" in got._jdf.queryExecution().toString()


def test_templates(spark):
    text = F.lit(T.template("coregis"))
    assert "Inc=7 " in spark.range(1).select(T.set_symbol(text, "Inc", F.lit(7))).first()[0]
    names = [n.rstrip("*") for n, _ in T.symbols("displacement")]
    assert names[:6] == ["Im1", "Im2", "Masq", "Dir", "Pyr", "Inc"] and dict(T.symbols("displacement"))["Pyr"] == "PyramSat/"
    assert len(T.symbols("coregis")) == len(T.symbols("bathy")) + 8
    with pytest.raises(ValueError):
        T.template("other")


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    from orthoflow.streaming import ingest

    rng = np.random.default_rng(7)
    rows = [(int(r), int(c), k, float(rng.integers(-5, 6)), float(rng.integers(-5, 6)), int(rng.integers(0, 256))) for k in range(4) for r in range(3) for c in range(3)]
    for k in range(4):
        spark.createDataFrame([x for x in rows if x[2] == k], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.layer_stream(spark, str(tmp_path / "in"), 1), "sums", str(tmp_path / "state"), 0.1)
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("sums").select("r", "c", "ew", "ns", "na").collect()))
    want = windows.pixel_sums(spark.createDataFrame(rows, ingest.SCHEMA), 0.1).select("r", "c", "ew", "ns", "na")
    assert got == sorted(map(tuple, want.collect()))
    assert ingest.magnitudes(spark.table("sums")).count() == 9


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4096
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grids(spark):
    a = {"ulx": 0.0, "uly": 0.0, "xres": 10.0, "yres": -10.0}
    src = pixels(spark, np.arange(16, dtype=float).reshape(4, 4))
    assert gridding.align(src, a, dict(a), 4, 4) is src
    moved = image(gridding.align(src, a, a | {"ulx": 10.0}, 4, 4), (4, 4))
    assert np.array_equal(moved[:, :3], np.arange(16).reshape(4, 4)[:, 1:]) and np.isnan(moved[:, 3]).all()
    smooth = image(gridding.align(src, a, a | {"ulx": 5.0}, 4, 3, nearest=False), (4, 3))
    assert np.allclose(smooth[:, 1], np.arange(16).reshape(4, 4)[:, 1:3].mean(1))
    bands = spark.createDataFrame([(10.0, -10.0), (20.0, -10.0)], "xres double, yres double")
    grids = spark.createDataFrame([(20, "g")], "res int, grid string")
    with pytest.raises(Exception, match="not square"):
        gridding.grids_by_resolution(bands.where("xres = 20"), grids).collect()
    with pytest.raises(Exception, match="no grid"):
        gridding.grids_by_resolution(bands.where("xres = 10"), grids).collect()


def test_raster_information(spark, tmp_path):
    gt = (300000.0, 10.0, 0.0, 4900020.0, 0.0, -10.0)
    (tmp_path / "a.tif").write_bytes(rasters.encode(np.zeros((3, 5), "uint16"), gt))
    row = rasters.tiff_info(rasters.tiff_files(spark, str(tmp_path))).first()
    assert (row["rows"], row["cols"], row["tiled"], tuple(row["geotransform"])) == (3, 5, False, gt)
    meta = spark.createDataFrame([("a", "b", [1.0], "x")], "raster string, ref string, geotransform array<double>, srs_wkt string")
    ref = spark.createDataFrame([("b", [2.0], "y")], "raster string, geotransform array<double>, srs_wkt string")
    row = rasters.georeference(meta, ref).first()
    assert (row["geotransform"], row["srs_wkt"]) == ([2.0], "y")


def test_listed_layers(spark):
    lists = lambda a: spark.createDataFrame([(1, a)], "id int, arguments array<string>")
    assert [r["duration_days"] for r in scenes.listed_layers(lists(["a", "b", "c", "12", "d", "e", "f", "24.5"])).collect()] == [12, 24.5]
    with pytest.raises(Exception, match="four arguments"):
        scenes.listed_layers(lists(["a"])).collect()
