"""Every registered query with SQL against an independent engine, on the smallest tables; the rest must run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from trialforge.plans import catalogue

QUERIES, SQL = catalogue.collect()


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "null"
    return repr(float(x)).removesuffix(".0") if isinstance(x, float) else str(x)


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, engine, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert canon(got) == canon(engine.execute(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.collect()[0]) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
