"""Counts, averages and shares. Every grouped sort breaks ties by the keys, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, *keys: str | Column, name: str = "shipment_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def most_first(counts: DataFrame, name: str = "shipment_count", limit: int | None = None) -> DataFrame:
    """Largest count first, then by the other columns with NULL last; ``limit`` rows of it when given."""
    ties = [F.asc_nulls_last(f"`{column}`") for column in counts.columns if column != name]
    ranked = counts.orderBy(F.desc(f"`{name}`"), *ties)
    return ranked if limit is None else ranked.limit(limit)


def customer_stats(df: DataFrame) -> DataFrame:
    """Per shipper name: smallest phone, rows, and distinct consignee names."""
    return df.groupBy("shipper_name").agg(
        F.min("shipper_phone").alias("shipper_phone"),
        F.count(F.lit(1)).alias("shipment_count"),
        F.countDistinct("consignee_name").alias("unique_consignees"),
    )


def average_of(df: DataFrame, column: str, average: str, rows: str) -> DataFrame:
    """Average of the readable numbers beside the count of all rows."""
    return df.agg(
        F.round(F.avg(column).cast("double"), 6).alias(average),
        F.count(F.lit(1)).alias(rows),
    )


def with_share(counts: DataFrame, whole: Column, count: str, name: str = "Percentage") -> DataFrame:
    """Adds each count as percent of ``whole``, a scalar subquery, to two decimals."""
    share = F.round(F.col(f"`{count}`") * F.expr("100.0BD") / whole, 2)
    return counts.withColumn(name, share.cast("double"))


def grand_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return total(df).scalar()


def completeness(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is not NULL, and where it is not empty either, in one pass."""
    at = F.col(column)
    return df.agg(
        F.count(at).alias("total_with_value"),
        F.count_if(at.isNotNull() & (at != "")).alias("non_empty"),
    )


def sample_groups(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Counts of ``n`` groups: the first in order of the key, where the order is otherwise left open."""
    return count_by(df, column, name="count").orderBy(F.asc_nulls_last(column)).limit(n)


def next_position(widgets: DataFrame) -> DataFrame:
    """Position after the last one, 0 in an empty table."""
    return widgets.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position"))
