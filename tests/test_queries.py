"""The registered table queries against DuckDB, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparloom import queries


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, sf, con):
    want, got = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda data, cols: sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in data)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
