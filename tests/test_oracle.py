"""Every core query against DuckDB over the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tracemill.plans import catalog


def _plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.9g}" if abs(v) < 10**8 else str(v)
    return str(v).removesuffix("+00:00")


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
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(_plain(r[k]) for k in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
