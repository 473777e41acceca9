"""Ranks from counts per bucket of the sort key, so that rows at any rank are found without sorting what is before them.

A bucket is a normalised date and a range of ``BLOCK_IDS`` ids, or the range alone. Counts of buckets add up: they are
stored beside the shipments, batch by batch, or taken from the rows at hand within the same plan. The buckets that hold
the wanted ranks are found by a running sum over the counts; only their rows are read, filtered by bounds that are
scalar subqueries, and numbered inside each bucket. Everything is one lazy plan, and no task gets more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import OTHER_MONTH

BLOCK_IDS = 1 << 16
_MONTH_LENGTH = 6
DAY, BLOCK, ROWS = "creation_ymd", "block", "n"


def block_of(block_ids: int = BLOCK_IDS) -> Column:
    return F.floor(F.col("id") / F.lit(block_ids)).cast("long")


def bucket_counts(df: DataFrame, by_date: bool = True, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(creation_ymd, block, n) of some rows, or (block, n)."""
    keys = [F.col(DAY)] if by_date else []
    return df.groupBy(*keys, block_of(block_ids).alias(BLOCK)).agg(F.count(F.lit(1)).alias(ROWS))


def write_counts(df: DataFrame, path: str) -> None:
    """Adds the counts of new shipments to those stored at ``path``."""
    bucket_counts(df).write.mode("append").parquet(path)


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(f"{DAY} string, {BLOCK} long, {ROWS} long").parquet(path)
    return stored.groupBy(DAY, BLOCK).agg(F.sum(ROWS).alias(ROWS))


def tie_break(df: DataFrame) -> Column:
    """Puts rows of one date and id in an order of their own, so that pages don't overlap where ids repeat."""
    return F.xxhash64(*[F.col(name) for name in df.columns])


def newest_order(df: DataFrame, by_date: bool) -> list[Column]:
    day = [F.desc_nulls_first(DAY)] if by_date else []
    return [*day, F.desc("id"), tie_break(df)]


def rows_between(
    df: DataFrame, first: int, last: int, by_date: bool, counts: DataFrame | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Rows of the ranks ``first`` to ``last`` (from 1), newest first, with their ``rank_``; not sorted.

    ``counts`` are those of exactly these rows by date and block; without them they are taken from the rows.
    """
    keys = [DAY, BLOCK] if by_date else [BLOCK]
    if counts is None:
        counts = bucket_counts(df, by_date, block_ids)
    elif not by_date:
        counts = counts.groupBy(BLOCK).agg(F.sum(ROWS).alias(ROWS))
    order = [F.desc_nulls_first(key) for key in keys]
    # one narrow row per bucket, whatever is in it
    upto = F.sum(ROWS).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto_", upto).where((F.col("upto_") >= first) & (F.col("upto_") - F.col(ROWS) < last))
    ends = [F.min(BLOCK).alias("low"), F.max(BLOCK).alias("high")]
    if by_date:
        month = F.substring(DAY, 1, _MONTH_LENGTH)
        ends += [F.min(month).alias("from"), F.max(month).alias("to")]
    ends = found.agg(F.struct(*ends)).scalar()
    near = df.where((F.col("id") >= ends["low"] * block_ids) & (F.col("id") < (ends["high"] + 1) * block_ids))
    if by_date and "creation_month" in df.columns:
        month = F.col("creation_month")
        near = near.where((month == OTHER_MONTH) | ((month >= ends["from"]) & (month <= ends["to"])))
    touched = found.select(
        *[F.col(key).alias(f"of_{key}") for key in keys], (F.col("upto_") - F.col(ROWS)).alias("before_")
    )
    same = F.lit(True)
    near = near.withColumn("block_", block_of(block_ids))
    for key, mine in zip(keys, [DAY, "block_"] if by_date else ["block_"]):
        same = same & F.col(mine).eqNullSafe(F.col(f"of_{key}"))
    inside = Window.partitionBy(*[f"of_{key}" for key in keys]).orderBy(*newest_order(df, by_date))
    ranked = near.join(touched, same).withColumn("rank_", F.col("before_") + F.row_number().over(inside))
    return ranked.where(F.col("rank_").between(first, last)).select(*df.columns, "rank_")


def newest_rows(df: DataFrame, n: int, counts: DataFrame | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The ``n`` rows with the largest ids, unsorted: all of the blocks above the border, and the newest of the block at it."""
    if counts is None:
        counts = bucket_counts(df, False, block_ids)
    else:
        counts = counts.groupBy(BLOCK).agg(F.sum(ROWS).alias(ROWS))
    upto = F.sum(ROWS).over(Window.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto_", upto).where(F.col("upto_") >= n)
    border = reached.agg(F.max(F.struct(F.col(BLOCK), (F.col("upto_") - F.col(ROWS)).alias("before")))).scalar()
    block = border["block"]
    # without a border there are fewer rows than asked for
    above = df.where(block.isNull() | (F.col("id") >= (block + 1) * block_ids))
    edge = df.where((F.col("id") >= block * block_ids) & (F.col("id") < (block + 1) * block_ids))
    inside = Window.partitionBy(block_of(block_ids)).orderBy(*newest_order(df, False))
    edge = edge.withColumn("rank_", F.row_number().over(inside)).where(F.col("rank_") <= F.lit(n) - border["before"])
    return above.unionByName(edge.drop("rank_"))
