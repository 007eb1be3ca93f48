"""The queries of this package that SQL can express, against that SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quire.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("~" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
