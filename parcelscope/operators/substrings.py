"""Substring lookups by an index of three-character runs ("grams") of chosen columns.

A row holds a text only if it holds all grams of it. So the postings of a text's grams are read and intersected, the few
rows left are joined in by key, and the LIKE itself decides. Patterns are cut at their wildcards: any part of three
characters or more helps. A pattern without such a part, and a column that isn't indexed, scan as before, so a lookup
gives the same rows with and without an index.

Batches of rows append their postings. A changed row appends those of its new text; stale postings only cost a look at
a row that the LIKE then refuses.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import contains_like

GRAM = 3
# The columns that substring questions look into.
LOOKUP_COLUMNS = (
    "number_shipment",
    "shipment_reference_number",
    "shipper_name",
    "shipper_phone",
    "consignee_name",
    "consignee_phone",
)


class GramIndex(NamedTuple):
    """Postings ``(column, gram, key)`` and the columns they cover."""

    postings: DataFrame
    columns: tuple[str, ...]
    key: str


def _grams(text: Column) -> Column:
    last = F.length(text) - (GRAM - 1)
    every = F.transform(F.sequence(F.lit(1), last), lambda at: F.substr(text, at, F.lit(GRAM)))
    return F.when(last >= 1, F.array_distinct(every))


def build_grams(df: DataFrame, columns: tuple[str, ...] = LOOKUP_COLUMNS, key: str = "id") -> DataFrame:
    """Postings ``(column, gram, key)`` of the texts of some columns, each once per row; short and null texts have none."""
    cells = F.array(*[F.struct(F.lit(name).alias("column"), _grams(F.col(name).cast("string")).alias("grams")) for name in columns])
    cell = df.select(key, F.explode(cells).alias("cell"))
    return cell.select(F.col("cell.column").alias("column"), F.explode("cell.grams").alias("gram"), key)


def add_grams(df: DataFrame, path: str, tasks: int, columns: tuple[str, ...] = LOOKUP_COLUMNS, key: str = "id") -> None:
    """Appends the postings of new or changed rows, one folder per column, sorted by gram inside each file.

    The texts move, not the postings, which are many times larger: a task gets whole texts, cuts them and sorts what it
    writes. Where a row goes follows from its key and text, so neither a frequent gram nor a frequent key fills one
    task. Each column is a write of its own, so a task sorts the narrow postings of one column only.
    """
    for name in columns:
        texts = df.select(key, F.col(name).cast("string").alias(name)).where(F.length(name) >= GRAM)
        cut = build_grams(texts.repartition(tasks, key, name), (name,), key).select("gram", key)
        cut.sortWithinPartitions("gram", key).write.mode("append").parquet(f"{path}/column={name}")


def load_grams(spark: SparkSession, path: str, columns: tuple[str, ...] = LOOKUP_COLUMNS, key: str = "id") -> GramIndex:
    stored = spark.read.schema(f"gram string, {key} long, column string").parquet(path)
    return GramIndex(stored, columns, key)


def grams_of(pattern: str) -> list[str]:
    """Grams that every text matching ``%pattern%`` holds; none if the pattern has no plain part long enough."""
    parts = re.split(r"\\.?|[%_]", pattern, flags=re.DOTALL)  # a backslash changes what follows it
    return sorted({part[at : at + GRAM] for part in parts for at in range(len(part) - GRAM + 1)})


def candidate_keys(index: GramIndex, column: str, pattern: str) -> DataFrame | None:
    """Keys of the rows that may match, or ``None`` where only a scan can tell."""
    wanted = grams_of(pattern)
    if column not in index.columns or not wanted:
        return None
    asked = (F.col("column") == column) & F.col("gram").isin(wanted)
    held = [F.bool_or(F.col("gram") == gram).alias(f"has_{at}") for at, gram in enumerate(wanted)]
    found = index.postings.where(asked).groupBy(index.key).agg(*held)
    return found.where(reduce(and_, [F.col(f"has_{at}") for at in range(len(wanted))])).select(index.key)


def where_contains(df: DataFrame, column: str, pattern: str, index: GramIndex | None = None) -> DataFrame:
    """Rows whose column contains the pattern, looked up in the index where it can tell."""
    keys = None if index is None else candidate_keys(index, column, pattern)
    if keys is not None:
        df = df.join(keys, index.key, "left_semi")
    return df.where(contains_like(F.col(f"`{column}`").cast("string"), pattern))
