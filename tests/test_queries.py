"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from eddyline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str | bytes):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.date | datetime.datetime):
        return str(pd.Timestamp(v))
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
