"""Every query with SQL gives the same rows as DuckDB on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, views, name):
    df = entry.queries()[name](spark, DATA)
    rel = views.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
