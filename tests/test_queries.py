"""Every query against its DuckDB SQL on the smallest tables; those without SQL must give rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from rastrel import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float | np.floating) and math.isnan(v):
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating):
        return int(v) if float(v).is_integer() else float(v)
    return v


def rows(pdf, names):
    return sorted(repr(tuple(map(plain, r))) for r in pdf[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(got, names) == rows(want, names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
