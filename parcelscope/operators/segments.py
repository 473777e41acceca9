"""A search index that grows: every batch of rows is a segment of postings of its own.

A batch names the keys it removes, because their rows were deleted or come again with other texts: their postings in
earlier segments no longer count. A search reads the postings of its words from all segments together and leaves those
out. Folding writes the live postings as one segment to a new place. Segments are numbered by the caller, in order; a
batch that is written again under its number replaces itself, so a job that failed halfway is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import store_index, write_index


def add_segment(
    df: DataFrame,
    path: str,
    number: int,
    *columns: str,
    tasks: int,
    key: str = "id",
    removed: DataFrame | None = None,
) -> None:
    """Adds the rows of a batch; ``removed`` holds the keys whose earlier postings are void, replaced ones too.

    The removals are written first: a search in between finds neither the old nor the new text of a replaced row.
    """
    gone = df.select(key).limit(0) if removed is None else removed.select(key)
    gone.write.mode("overwrite").parquet(f"{path}/removed/segment={number}")
    store_index(df, f"{path}/postings/segment={number}", tasks, *columns, key=key, mode="overwrite")


def open_segments(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The live postings of all segments, for ``search_index``."""
    postings = spark.read.schema(f"token string, {key} long, pos int, segment int, bucket int").parquet(f"{path}/postings")
    removed = spark.read.schema(f"{key} long, segment int").parquet(f"{path}/removed")
    last = removed.groupBy(key).agg(F.max("segment").alias("gone"))
    live = F.col("gone").isNull() | (F.col("segment") >= F.col("gone"))
    return postings.join(last, key, "left").where(live).select("token", key, "pos", "bucket")


def fold_segments(spark: SparkSession, path: str, to: str, number: int, tasks: int, key: str = "id") -> None:
    """Writes the live postings as segment ``number``, the last one folded, below a new path. Later batches go on there."""
    live = open_segments(spark, path, key).select("token", key, "pos")
    live.select(key).limit(0).write.parquet(f"{to}/removed/segment={number}")
    write_index(live, f"{to}/postings/segment={number}", tasks, key)
