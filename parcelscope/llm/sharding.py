"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are put in order of their id by one range shuffle of narrow rows (id, size, checksum; never the text). Every
partition adds up its sizes on the way and is written once with them. The totals of the partitions, one row each, give
every partition its offset, and offset plus running sum is the global prefix sum. A row belongs to the shard in which
the middle of its bytes lies, so a shard is off the equal target by less than its two largest rows at the cuts.

Defined results: null ids come first; equal ids are ordered by checksum and size and then by their place in the input,
so a key that many rows share is spread over partitions; a null text has no bytes and still takes a slot (each row
counts 1 byte more than its text); an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

SHARDS = 16


def with_prefix_sums(rows: DataFrame, order: list[str], size_col: str, tasks: int | None = None) -> DataFrame:
    """Adds ``before_`` (sum of sizes of earlier rows), ``at_`` (number of earlier rows) and ``total_`` (all sizes)."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("tie_", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(tasks, *order, "tie_").sortWithinPartitions(*order, "tie_").drop("tie_")
    sorted_rows = sorted_rows.withColumn("part_", F.spark_partition_id())
    schema = T.StructType(list(sorted_rows.schema.fields)).add("before_", "long").add("at_", "long")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = 0
        for batch in batches:
            sizes = batch.column(size_col).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            batch = batch.append_column("before_", pa.array(ends - sizes, pa.int64()))
            yield batch.append_column("at_", pa.array(count + np.arange(len(sizes)), pa.int64()))
            total, count = int(ends[-1]) if len(ends) else total, count + len(sizes)

    parts = stored(sorted_rows.mapInArrow(running, schema), "prefix_sums")
    # one row per partition, so the window over them is as small as the number of tasks
    totals = parts.groupBy("part_").agg(F.sum(size_col).alias("bytes_"), F.count(F.lit(1)).alias("rows_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part_",
        F.coalesce(F.sum("bytes_").over(earlier), F.lit(0)).alias("bytes_before_"),
        F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("rows_before_"),
        F.sum("bytes_").over(Window.partitionBy()).alias("total_"),
    )
    return (
        parts.join(F.broadcast(offsets), "part_")
        .withColumn("before_", F.col("before_") + F.col("bytes_before_"))
        .withColumn("at_", F.col("at_") + F.col("rows_before_"))
        .drop("part_", "bytes_before_", "rows_before_")
    )


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, checksum of the text, shard and slot in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size")
    shard = F.expr(f"least({shards - 1}, CAST((2 * before_ + size) * {shards} DIV (2 * total_) AS INT))")
    cut = placed.withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min("at_").alias("first_"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at_") - F.col("first_")).alias("slot")
    )
