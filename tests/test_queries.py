"""Every registered query with SQL gives DuckDB's rows at the scale that the driver compares."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from chartweave.plans import answers, corpus, exports, flows, history, inputs, notes, timelines

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = history.SQL | corpus.SQL | answers.SQL | flows.SQL | notes.SQL | exports.SQL | timelines.SQL | inputs.SQL
QUERIES = history.QUERIES | corpus.QUERIES | answers.QUERIES | flows.QUERIES | notes.QUERIES | exports.QUERIES | timelines.QUERIES | inputs.QUERIES


def plain(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.5f}"
        return f"{x:.5f}" if hasattr(x, "dtype") and x.dtype.kind in "iuf" else (f"{float(x):.5f}" if isinstance(x, int) and not isinstance(x, bool) else str(x))

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.sql(SQL[name]).df())


def test_registered():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert set(QUERIES) <= set(found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
