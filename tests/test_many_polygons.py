"""Overlays of the footprints of large groups, against their SQL."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from orthoflow.operators import geometry, overlay
from orthoflow.plans import ORACLES, QUERIES
from orthoflow.plans.fixtures import supplier_rings


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """A folder with 300 suppliers in one nation, 5 in another, 1 in a third and 2 in none."""
    folder = tmp_path_factory.mktemp("crowd")
    nation = "CASE WHEN k < 300 THEN 3 WHEN k < 305 THEN 7 WHEN k < 306 THEN 11 END"
    duckdb.sql(f"COPY (SELECT k * 13 + 4 AS s_suppkey, CAST({nation} AS INTEGER) AS s_nationkey FROM range(308) t(k)) TO '{folder}/supplier.parquet'")
    return str(folder)


def equals_sql(spark, folder, name):
    columns = QUERIES[name](spark, folder).columns
    got = sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    want = sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert len(got) == len(want) > 20_000
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-5 and a[3:] == b[3:]


def overlaid(monkeypatch):
    """How many pairs of rings each overlay() took."""
    seen, edges = [], overlay._edges
    monkeypatch.setattr(overlay, "_edges", lambda pairs: seen.append(pairs.count()) or edges(pairs))
    return seen


def test_equal_rings_are_overlaid_once_for_both(spark, crowd, monkeypatch):
    seen = overlaid(monkeypatch)
    equals_sql(spark, crowd, "polygon_both")
    assert max(seen) <= 51 * 51 + 10 < 300 * 299 / 2  # a nation has at most 51 different rings


def test_equal_rings_are_overlaid_once_for_either(spark, crowd, monkeypatch):
    seen = overlaid(monkeypatch)
    equals_sql(spark, crowd, "polygon_either")
    assert max(seen) <= 51 * 51 + 10


def test_equal_rings_are_overlaid_once_for_the_first_alone(spark, crowd, monkeypatch):
    seen = overlaid(monkeypatch)
    equals_sql(spark, crowd, "polygon_first")
    assert max(seen) <= 51 * 51 + 10


@pytest.mark.parametrize("how", ["both", "either", "first"])
def test_two_classes_are_overlaid_once_for_both_directions(spark, crowd, monkeypatch, how):
    seen = overlaid(monkeypatch)
    pairs = QUERIES[f"polygon_{how}"](spark, crowd).select("id_a", "id_b").collect()
    assert seen == [51 * 52 / 2 + 5 * 4 / 2]  # a class of one member, as in the nation of 5, is not overlaid with itself
    assert len(set(map(tuple, pairs))) == len(pairs) > 20_000


def rounded_before_expansion(df):
    """Whether areas are rounded while they still are areas of classes: in the plan, below the explosion of members."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "round(" in line]
    members = [k for k, line in enumerate(lines) if "Generate explode(ids_" in line]
    return len(at) == 1 and len(members) == 2 and min(at) > max(members)


def test_areas_are_rounded_once_for_classes_for_either(spark, crowd):
    assert rounded_before_expansion(QUERIES["polygon_either"](spark, crowd))


def test_areas_are_rounded_once_for_classes_for_the_first_alone(spark, crowd):
    assert rounded_before_expansion(QUERIES["polygon_first"](spark, crowd))


@pytest.mark.parametrize("how", ["both", "either", "first"])
def test_members_in_many_parts_meet_once(spark, crowd, how):
    rings = supplier_rings(spark, crowd, "dented")
    classes = overlay.ring_classes(rings, ["nation"])
    assert overlay.member_parts(rings, classes, ["nation"], most=2).count() > classes.count()
    pairs = lambda **k: sorted(map(tuple, overlay.overlay_areas(rings, how, digits=5, **k).collect()))
    assert pairs(most=2) == pairs()


def test_pairs_of_convex_rings_are_made_beside_the_arrays(spark, crowd, monkeypatch):
    seen, frame = [], type(spark.range(1))
    for name in ("mapInPandas", "mapInArrow"):
        plain = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda df, *a, plain=plain, **k: seen.append(df.count()) or plain(df, *a, **k))
    equals_sql(spark, crowd, "polygon_clip")
    assert max(seen) <= 10  # pairs of parts (3, 1 and 1), not of rings (44,860)


@pytest.mark.parametrize("most, at_once", [(512, 8192), (7, 10)])
def test_many_clips_equal_plain_ones(spark, most, at_once):
    rng = random.Random(3)

    def convex(corners):
        x, y, turns = rng.uniform(0, 12), rng.uniform(0, 12), sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
        ring = [(x + 5 * math.cos(t), y + 5 * math.sin(t)) for t in turns]
        return ring if rng.random() < 0.5 else ring[::-1]

    square = [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]
    rings = {k: convex(rng.randint(3, 9)) for k in range(50)} | {50: square, 51: square[::-1], 52: [(8.0, 2.0), (12.0, 2.0), (12.0, 8.0)], 53: [(40.0, 40.0), (41.0, 40.0), (41.0, 41.0)]}
    closed = {k: [*ring, ring[0]] for k, ring in rings.items()}
    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([("n", k, ring) for k, ring in closed.items()] + [("other", 60, closed[50]), (None, 61, closed[50])], f"nation string, det_id int, ring {point}")
    pairs = [(a, b) for a in rings for b in rings if a < b]
    clipped = {(a, b): geometry.clip_convex(rings[a], rings[b]) for a, b in pairs}
    want = {k: ring for k, ring in clipped.items() if len(ring) > 2}
    size = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]]))) / 2
    rows = geometry.intersection_areas(df, most=most, at_once=at_once).collect()
    got = {(r["id_a"], r["id_b"]): r["area"] for r in rows}
    assert len(got) == len(rows) and set(got) <= set(want)
    assert all(abs(got.get(k, 0.0) - size(ring)) < 1e-9 for k, ring in want.items())
    both = spark.createDataFrame([(a, closed[a], b, closed[b]) for a, b in pairs], f"id_a int, ring_a {point}, id_b int, ring_b {point}")
    found = {(r["id_a"], r["id_b"]): [tuple(p) for p in r["ring"]] for r in geometry.intersections(both).collect()}
    assert found == {k: [*ring, ring[0]] for k, ring in want.items()}
