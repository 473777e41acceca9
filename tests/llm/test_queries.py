"""Registered queries against their DuckDB texts, and the queries without one against brute force."""

import duckdb
import pytest
from test_registry import SF_DIR, TABLES, table_of

import __spark_entry__ as driver
from parcelscope.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_all_ten_and_the_pipeline_are_registered():
    names = [name for name in driver.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names if name[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in driver.queries() and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, key):
    found = QUERIES[key](spark, SF_DIR)
    expected = duck.execute(ORACLES[key])
    names = [column[0] for column in expected.description]
    assert table_of(found.columns, found.collect()) == table_of(names, expected.fetchall())
