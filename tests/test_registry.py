"""Every registered query against its DuckDB text, on the smallest test tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as driver
from parcelscope.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value:.9g}"
    assert not isinstance(value, decimal.Decimal), "cast decimals, the engines differ in their types"
    return f"{type(value).__name__} {value}"


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return [columns[at] for at in order], sorted(tuple(plain(row[at]) for at in order) for row in rows)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, key):
    found = QUERIES[key](spark, SF_DIR)
    expected = duck.execute(ORACLES[key])
    names = [column[0] for column in expected.description]
    assert table_of(found.columns, found.collect()) == table_of(names, expected.fetchall())


ORDERED = "m10_reports m10_searches m10_widgets j01_active_schedules monthly_by_phone monthly_sal daily_volume_by_date".split()


@pytest.mark.parametrize("key", ORDERED)
def test_order_equals_that_of_the_oracle(spark, duck, key):
    found = QUERIES[key](spark, SF_DIR)
    expected = duck.execute(ORACLES[key])
    names = [column[0] for column in expected.description]
    mine = [tuple(plain(row[name]) for name in names) for row in found.collect()]
    assert mine == [tuple(map(plain, row)) for row in expected.fetchall()]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())


def test_entry(spark):
    found = driver.entry(spark)
    assert found.columns == ["city", "shipment_count"] and found.count() > 0
