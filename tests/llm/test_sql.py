"""Operators that SQL can express, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from sparloom.llm import queries


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda data, cols: sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in data)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
