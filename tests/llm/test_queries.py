"""The registered queries against their SQL in DuckDB on a small scale."""

import os

import duckdb
import pytest

from rasterloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    rows, other = queries.queries()[name](spark, DIR).toPandas(), tables.sql(queries.oracle_sql()[name]).df()
    cols = sorted(rows.columns)
    assert cols == sorted(other.columns) and len(rows) == len(other)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (rows, other))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_a_row_for_each_input(spark, name):
    found = queries.queries()[name](spark, DIR)
    table, key = ("pages", "page_id") if name.startswith("op2_") else ("documents", "doc_id")
    rows = spark.read.parquet(f"{DIR}/{table}.parquet")
    assert found.select(key).distinct().count() == rows.count()
