"""Changes of projection, resampling by area, and dense matching against brute force in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow.functions import projection as P
from orthoflow.operators import gridding, matching
from orthoflow.plans import QUERIES

SF = "/root/testdata/sf0.001"


def pixels(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)], "r int, c int, v double")


def test_central_meridian_is_the_arc_of_the_ellipse(spark):
    lats = [0.0, 10.0, 48.0, 83.9, -33.0]
    at = P.to_plane(F.lit(9.0), F.col("lat"), F.lit(32))
    got = spark.createDataFrame([(v,) for v in lats], "lat double").withColumn("at", at).select("lat", "at.x", "at.y").collect()
    e2 = P.ECCENTRICITY**2
    for r in got:
        phi = np.linspace(0, math.radians(r["lat"]), 200_001)
        arc = np.trapezoid(P.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
        assert r["x"] == 500_000 and abs(r["y"] - 0.9996 * arc) < 1e-4


def test_projection_keeps_angles_and_comes_back(spark):
    rng = np.random.default_rng(1)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(5, 13, 300), rng.uniform(-70, 80, 300))]
    df = spark.createDataFrame(places, "lon double, lat double")
    plane = df.withColumn("at", P.to_plane(F.col("lon"), F.col("lat"), F.lit(32), F.col("lat") < 0))
    back = P.to_degrees(F.col("at.x"), F.col("at.y"), F.lit(32), F.col("lat") < 0)
    got = plane.withColumn("d", back).select("lon", "lat", F.col("d.lon").alias("lon2"), F.col("d.lat").alias("lat2")).collect()
    assert all(abs(r["lon"] - r["lon2"]) < 1e-11 and abs(r["lat"] - r["lat2"]) < 1e-11 for r in got)
    # a small step east and one of the same length north have images of equal length at a right angle
    h, e2 = 1e-5, P.ECCENTRICITY**2
    step = lambda a, b: P.to_plane(F.col("lon") + a, F.col("lat") + b, F.lit(32))
    cols = [s[n].alias(f"{n}{k}") for k, s in enumerate((step(h, 0), step(-h, 0), step(0, h), step(0, -h))) for n in "xy"]
    for r in df.select("lat", *cols).collect():
        phi = math.radians(r["lat"])
        w = 1 - e2 * math.sin(phi) ** 2
        east = np.array([r["x0"] - r["x1"], r["y0"] - r["y1"]]) / (math.cos(phi) / math.sqrt(w))
        north = np.array([r["x2"] - r["x3"], r["y2"] - r["y3"]]) / ((1 - e2) / w**1.5)
        assert np.allclose(np.linalg.norm(east), np.linalg.norm(north), rtol=1e-6) and abs(east @ north) < 1e-6 * (east @ east) ** 0.5 * (north @ north) ** 0.5


def test_edges_are_made_denser(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (10, 0), (10, 4), (10, 4), (0, 0)]])
    got = [(p["x"], p["y"]) for p in spark.range(1).select(P.densified(ring, 4.0).alias("r")).first()["r"]]
    assert got[:5] == [(0, 0), (10 / 3, 0), (20 / 3, 0), (10, 0), (10, 4)] and got[-1] == (0, 0)
    assert all(math.dist(p, q) <= 4.0 + 1e-9 for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("scale,rows,cols", [(2.5, 4, 6), (0.3, 30, 40), (1.0, 9, 14), (3.0, 3, 5), (4 / 3, 7, 11)])
def test_area_means(spark, scale, rows, cols):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, (9, 14)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    df = pixels(spark, a).withColumn("bad", F.col("v") > 25)
    got = {(r["r"], r["c"]): r for r in gridding.area_resample(df, scale, scale, rows, cols, ["v"], ["bad"]).collect()}
    share = lambda i, n: np.clip(np.minimum(np.arange(n) + 1, (i + 1) * scale) - np.maximum(np.arange(n), i * scale), 0, None)
    assert set(got) == {(i, j) for i in range(rows) for j in range(cols) if i * scale < 9 - 1e-9 and j * scale < 14 - 1e-9}
    for (i, j), r in got.items():
        w = np.outer(share(i, 9), share(j, 14))
        held = ~np.isnan(a)
        want = (w[held] @ a[held]) / w[held].sum() if w[held].sum() > 1e-9 else None
        assert r["v"] is None if want is None else abs(r["v"] - want) < 1e-9


def smooth(shape, dy=0.0, dx=0.0):
    """A texture of forty waves, 6 to 15 cells long in all directions, moved by a part of a cell."""
    rng = np.random.default_rng(11)
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    waves = zip(rng.uniform(6, 15, 40), rng.uniform(0, np.pi, 40), rng.uniform(0, 2 * np.pi, 40))
    return sum(10 * np.cos(2 * np.pi / n * ((y - dy) * np.sin(t) + (x - dx) * np.cos(t)) + p) for n, t, p in waves)


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 100, (2, 12, 13)).astype(float)
    a[3, 4] = b[7, 7] = np.nan
    b[:, 11] = 5.0
    a[5, 2] = a[6, 9] = np.nan
    present = pixels(spark, a).where("v IS NOT NULL OR c < 6")  # some cells are null, others have no row
    got = {(r["r"], r["c"]): r for r in matching.dense_match(present, pixels(spark, b), 2, 1, -1.0).collect()}
    cc = np.full((5, 5, 12, 13), np.nan)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            for i in range(12):
                for j in range(13):
                    pairs = [(a[y, x], b[y + dy, x + dx]) for y in range(i - 1, i + 2) for x in range(j - 1, j + 2)
                             if 0 <= y < 12 and 0 <= x < 13 and 0 <= y + dy < 12 and 0 <= x + dx < 13]
                    pairs = [p for p in pairs if not np.isnan(p).any()]
                    own = 0 <= i + dy < 12 and 0 <= j + dx < 13 and not np.isnan(a[i, j]) and not np.isnan(b[i + dy, j + dx])
                    if own and len(pairs) > 4.5 and all(np.var(x) > 0 for x in zip(*pairs)):
                        cc[dy + 2, dx + 2, i, j] = np.corrcoef(*zip(*pairs))[0, 1]
    for i in range(12):
        for j in range(13):
            one = cc[:, :, i, j]
            if np.isnan(one).all():
                assert (i, j) not in got
                continue
            y, x = np.unravel_index(np.nanargmax(one), one.shape)
            r = got[i, j]
            assert abs(r["cc"] - one[y, x]) < 1e-9 and abs(r["py"] - (y - 2)) <= 1 and abs(r["px"] - (x - 2)) <= 1
            if 0 < y < 4 and 0 < x < 4 and not np.isnan(near := one[y - 1 : y + 2, x - 1 : x + 2]).any():
                fit = np.array([[near[2, 1] - 2 * near[1, 1] + near[0, 1], (near[2, 2] - near[2, 0] - near[0, 2] + near[0, 0]) / 4], [0, near[1, 2] - 2 * near[1, 1] + near[1, 0]]])
                fit[1, 0] = fit[0, 1]
                step = np.linalg.solve(fit, -np.array([near[2, 1] - near[0, 1], near[1, 2] - near[1, 0]]) / 2)
                if np.linalg.det(fit) > 0 and (np.abs(step) <= 1).all():
                    assert np.allclose([r["py"] - (y - 2), r["px"] - (x - 2)], step, atol=1e-6)


def test_a_part_of_a_cell_is_found(spark):
    a, b = smooth((40, 40)), smooth((40, 40), 1.3, -0.6)  # what the first has at r is in the second at r + 1.3
    got = matching.dense_match(pixels(spark, a), pixels(spark, b), 3, 5, 0.9).where("r BETWEEN 10 AND 29 AND c BETWEEN 10 AND 29").collect()
    assert len(got) == 400
    assert abs(np.mean([r["py"] for r in got]) - 1.3) < 0.1 and abs(np.mean([r["px"] for r in got]) + 0.6) < 0.1
    assert np.mean([abs(r["py"] - 1.3) < 0.1 and abs(r["px"] + 0.6) < 0.1 for r in got]) > 0.9


def test_far_offsets_are_found_from_coarse_to_fine(spark):
    rng = np.random.default_rng(2)
    wide = np.kron(rng.integers(0, 200, (30, 30)), np.ones((4, 4))) + rng.integers(0, 30, (120, 120))
    a, b = wide[20:84, 20:84], wide[29:93, 13:77]  # a[r, c] = b[r - 9, c + 7]
    got = matching.pyramid_match(pixels(spark, a), pixels(spark, b), 2, 3, 4, 0.95, 16).where("r BETWEEN 16 AND 47 AND c BETWEEN 8 AND 47").collect()
    right = np.mean([round(r["py"]) == -9 and round(r["px"]) == 7 for r in got])
    assert len(got) > 1000 and right > 0.97


def test_planted_shift_is_found_in_all_layers(spark):
    got = QUERIES["planted_shift"](spark, SF).toPandas()
    assert len(got) > 300 and ((got.py - 1).abs() < 0.1).mean() > 0.95 and ((got.px + 2).abs() < 0.1).mean() > 0.95


def test_a_cell_of_correlation_is_decoded(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,)], "cc double").select((matching.cc_byte(F.col("cc")) - 127) / 128).collect()
    assert np.allclose([r[0] for r in got], [-127 / 128, 0, 0.5, 1])


def test_overlay_of_dented_rings(spark):
    from orthoflow.operators import overlay

    star = lambda n, cx, cy, big, small, turn: [
        (cx + (big if k % 2 else small) * math.cos(math.pi * k / n + turn), cy + (big if k % 2 else small) * math.sin(math.pi * k / n + turn)) for k in range(2 * n)
    ]
    a, b = star(5, 50, 50, 40, 15, 0.1), star(7, 62, 45, 35, 20, 0.7)
    square, apart = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0)]
    closed = lambda ring: [(float(x), float(y)) for x, y in [*ring, ring[0]]]
    rows = [(1, closed(a), 2, closed(b)), (3, closed(square), 3, closed(square)), (4, closed(square), 5, closed(apart)), (6, closed(square[::-1]), 7, closed([(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0)]))]
    pairs = spark.createDataFrame(rows, "id_a int, ring_a array<struct<x:double,y:double>>, id_b int, ring_b array<struct<x:double,y:double>>")
    areas = {how: {r["id_a"]: r["area"] for r in overlay.overlay_area(overlay.overlay(pairs, how, 7.0)).collect()} for how in ("both", "either", "first")}
    y, x = np.mgrid[0:110:0.1, 0:110:0.1] + 0.05

    def inside(ring):
        out = np.zeros(x.shape, bool)
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (x2 - x1) * (y - y1) / (y2 - y1))
        return out

    in_a, in_b = inside(a), inside(b)
    for how, held in (("both", in_a & in_b), ("either", in_a | in_b), ("first", in_a & ~in_b)):
        assert abs(areas[how][1] - held.sum() / 100) < 2.0
    assert abs(areas["both"][1] + areas["first"][1] - abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, [*a[1:], a[0]]))) / 2) < 1e-6
    assert np.allclose([areas["both"][3], areas["either"][3], areas["either"][4], areas["both"][6], areas["either"][6], areas["first"][6]], [100, 100, 200, 25, 175, 75])
    assert 4 not in areas["both"] and 3 not in areas["first"]


@pytest.mark.parametrize("q", [0.5, 0.0, 1.0, 0.3])
def test_quantiles_of_keys_that_no_task_holds(spark, q, monkeypatch):
    from orthoflow.operators import statistics

    monkeypatch.setattr(statistics, "PARTS", 8)
    rng = np.random.default_rng(4)
    groups = {
        1: rng.normal(size=4001), 2: rng.integers(0, 3, 3000), 3: np.r_[rng.exponential(size=2500) ** 9, 1e300, -1e300], 4: np.full(2000, 7.0), 5: rng.normal(size=20),
        6: np.r_[np.zeros(1000), np.ones(1000)],
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["m"] for r in statistics.exact_quantiles(df, ["g"], F.col("v"), q, held=50).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[7] is None
    for k, own in groups.items():
        assert np.isclose(got[k], np.quantile(own.astype(float), q), rtol=1e-12, atol=0)


def test_modes_by_counts(spark):
    from orthoflow.operators import statistics

    df = spark.createDataFrame([(1, 2.0)] * 3 + [(1, 1.0)] * 3 + [(1, 5.0), (2, None), (3, 4.0), (3, None), (3, None)], "g int, v double")
    assert {r["g"]: r["m"] for r in statistics.exact_modes(df, ["g"], F.col("v")).collect()} == {1: 1.0, 2: None, 3: 4.0}
