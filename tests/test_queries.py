"""Registered queries of the engine against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidelog import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer lineitem events documents nation".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(str, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.SQL:
        assert rows(found) == rows(duck.execute(queries.SQL[name]).df())
    else:
        assert len(found)


def test_sql_has_a_query_each():
    assert set(queries.SQL) <= set(queries.QUERIES)
