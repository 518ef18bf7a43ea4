"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelkit import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = plans.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf, name):
    df = plans.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    columns = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, res.fetchall())
    assert len(got) == len(want)
    assert got == want or all(a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b)) for a, b in zip(got, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
