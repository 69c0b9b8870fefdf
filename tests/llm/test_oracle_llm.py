"""Queries for training data that SQL can express, against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from tests.test_oracle import _plain
from tracemill.llm import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    places = [want.columns.index(c) for c in cols]
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_plain(r[k]) for k in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0
