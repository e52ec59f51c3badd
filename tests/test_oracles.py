"""Each query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from orthoflow.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x + 0.0:.5f}"
    if isinstance(x, datetime.date):
        return x.isoformat()
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    near = lambda rows: sorted(tuple(cell(x) for x in r) for r in rows)
    got_rows = near(tuple(r[c] for c in columns) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    want_rows = near(tuple(r[i] for i in order) for r in want.fetchall())
    assert len(got_rows) == len(want_rows)
    for a, b in zip(got_rows, want_rows):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 2e-5


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
