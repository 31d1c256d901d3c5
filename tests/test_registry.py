"""Every registered query against its SQL in DuckDB on a small scale."""

import os

import duckdb
import pytest

from rasterloom.plans import registry

DIR = "/root/testdata/sf0.001"
SLOW = {"grid_search", "forest_accuracy"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_sql(spark, tables, name):
    rows = registry.queries()[name](spark, DIR).toPandas()
    assert len(rows)
    if name in registry.oracle_sql():
        other = tables.sql(registry.oracle_sql()[name]).df()
        cols = sorted(rows.columns)
        assert cols == sorted(other.columns) and len(rows) == len(other)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (rows, other))
        for c in cols:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
