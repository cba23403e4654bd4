"""Queries against DuckDB on the smallest tables; the iterative ones are held against each other in test_graph."""

import duckdb
import pytest

from orrery import queries

DATA = "/root/testdata/sf0.001"
TABLES = "lineitem", "orders"
SLOW = {"bfs_push_sparse", "bfs_pull", "bfs_blocked", "bfs_levels", "frontier_block", "cc_sizes", "cc_count", "vertex_program_labels", "pagerank", "pagerank_blocked", "pagerank_error_trace"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if x != x else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert str(plain(got)) == str(plain(want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
    assert set(queries.QUERIES) <= set(entry.queries())
