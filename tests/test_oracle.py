"""Every registered query with an oracle equals DuckDB on sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF01
from tools.oracle_check import table_hash

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert table_hash(df.columns, rows)[0] == table_hash(rel.columns, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_query_is_documented():
    for name, fn in E.queries().items():
        assert fn.__doc__, name
    assert set(E.oracle_sql()) <= set(E.queries())
