"""Every registered engine query against its SQL, on the smallest test data."""

import glob
import os

import pandas as pd
import pytest

from conftest import data_dir
from forerun.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = data_dir("sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple("null" if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
