"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from stonewatch.plans import all_queries

SF_DIR = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
# judged against one-by-one code in test_shifts.py
WITHOUT_SQL = {"shift_validation"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def text(value):
    if pd.isna(value):
        return "NULL"
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in WITHOUT_SQL
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
