"""Every query with SQL against DuckDB on the small tables, and that its columns tell something."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["captions", "lists", "heading_marks", "references", "figure_text", "garbled"])
def test_both_answers_occur(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    for c in got.columns[1:]:
        assert got[c].nunique(dropna=False) > 1 or c in ("doctags_", "garbled"), c
