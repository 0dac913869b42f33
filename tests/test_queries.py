"""Every registered query of the core against its SQL over the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _core():
    import importlib

    return {k: v for m in entry._CORE for k, v in importlib.import_module(m).QUERIES.items()}


def _plain(v):
    import numpy as np
    import pandas as pd

    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6g}"
    return str(v)


def _rows(df):
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(_core()))
def test_query(spark, oracle, name):
    got = _core()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = oracle.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
