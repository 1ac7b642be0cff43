"""Queries of the subpackage that have a DuckDB oracle equal it on the smallest tables."""

import os

import duckdb
import pytest

from umbra.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, DATA).toPandas()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    plain = lambda f: sorted(map(repr, f[names].astype(object).where(f[names].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
