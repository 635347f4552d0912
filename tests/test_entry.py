"""The driver's contract, and the queries against DuckDB."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tabplan.queries import KEYS, QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in KEYS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    return v if isinstance(v, str) else float(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, duck, key):
    got, want = QUERIES[key](spark, SF).toPandas(), duck.execute(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
