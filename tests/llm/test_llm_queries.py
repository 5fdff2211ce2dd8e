"""Registered queries of the subpackage against their SQL."""

import glob
import os

import pandas as pd
import pytest

from stonewatch.llm import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query(spark, name):
    got = registry.all_queries()[name](spark, SF_DIR).toPandas()
    sql = registry.all_oracles().get(name)
    if sql is None:
        tables = {"op10": ("pages", "page_id"), "op11": ("conversations", "conv_id")}
        table, key = tables.get(name.split("_")[0], ("documents", "doc_id"))
        want = set(pd.read_parquet(f"{SF_DIR}/{table}.parquet")[key])
        assert set(got[key]) == want
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
