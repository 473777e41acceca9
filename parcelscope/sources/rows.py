"""Rows that arrive as records with differing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """DataFrame of a caller's list of records: keys in the order first seen, missing ones NULL, values as text
    unless all of a key's values are of one type."""
    names = list(dict.fromkeys(name for row in rows for name in row))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    fields = [T.StructField(name, _type_of([row.get(name) for row in rows])) for name in names]
    values = [tuple(_as(row.get(field.name), field.dataType) for field in fields) for row in rows]
    return spark.createDataFrame(values, T.StructType(fields))


def _type_of(values: list) -> T.DataType:
    kinds = {type(value) for value in values if value is not None}
    plain = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
    if kinds == {int, float}:
        return T.DoubleType()
    return plain.get(kinds.pop(), T.StringType()) if len(kinds) == 1 else T.StringType()


def _as(value, dtype: T.DataType):
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        return str(value)
    return float(value) if isinstance(dtype, T.DoubleType) else value


def from_json_rows(df: DataFrame, column: str, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for records that are JSON text in a column of any size: one text column per key, NULL when missing."""
    parsed = F.from_json(F.col(column), T.StructType([T.StructField(key, T.StringType()) for key in keys]))
    return df.select(*keep, parsed.alias("record")).select(*keep, "record.*")


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Every key that occurs in the JSON records of a column, with the number of records that have it."""
    return (
        df.select(F.explode(F.json_object_keys(column)).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("records"))
    )
