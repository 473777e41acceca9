"""Scans, and the small tables as external parquet tables whose location moves to a new folder with each version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NOW, SHIPMENTS, TABLES
from .normalised import DERIVED_COLUMNS, normalise

_WITH_DERIVED = (
    ", creation_ymd string, creation_date date, creation_month string, "
    "weight_kg decimal(18,4), cod_amount decimal(18,4)"
)


def load_shipments(spark: SparkSession, path: str, normalised: bool = False) -> DataFrame:
    """Shipments under their fixed schema; no file is opened to infer it.

    ``normalised`` says that the path holds the stored normalised layer; raw shipments get its columns as expressions.
    """
    if not normalised:
        return normalise(spark.read.schema(SHIPMENTS).parquet(path))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SHIPMENTS) + _WITH_DERIVED
    return spark.read.schema(ddl).parquet(path).select(*SHIPMENTS.fieldNames(), *DERIVED_COLUMNS)


def load_jdbc(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Table of a PostgreSQL database, read by ``partitions`` tasks that each take a range of ids.

    User and password are options of the caller. Filters and columns are pushed into the database.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn="id",
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        driver="org.postgresql.Driver",
        fetchsize="10000",
    )
    return reader.options(**options).load()


def with_defaults(df: DataFrame, name: str, at=None, *beside) -> DataFrame:
    """Fills absent values of a new row of a small table; ``at`` is the time column of the change, ``beside`` stay next to it."""
    spec = TABLES[name]
    now = F.current_timestamp().cast("timestamp_ntz") if at is None else at
    columns = []
    for field in spec.schema:
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        given = given.cast(field.dataType)
        if field.name in spec.defaults:
            default = spec.defaults[field.name]
            given = F.coalesce(given, now if default is NOW else F.lit(default).cast(field.dataType))
        columns.append(given.alias(field.name))
    return df.select(*columns, *beside)


def ensure_tables(spark: SparkSession, folder: str, database: str = "default") -> list[str]:
    """Creates those of the four tables that the catalog does not have; returns their names."""
    created = []
    for name, spec in TABLES.items():
        if spark.catalog.tableExists(f"{database}.{name}"):
            continue
        path = _new_version(folder, name)
        spark.createDataFrame([], spec.schema).write.parquet(path)
        spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet", schema=spec.schema)
        created.append(name)
    return created


def load_table(spark: SparkSession, name: str, database: str = "default") -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.table(f"{database}.{name}")


def publish(df: DataFrame, name: str, folder: str, database: str = "default") -> str:
    """Writes a new version of a small table and points the catalog at it.

    The version that is being read stays untouched, so ``df`` may be computed from it, and readers see either the old
    table or the new one.
    """
    spark = df.sparkSession
    path = _new_version(folder, name)
    df.select(*TABLES[name].schema.fieldNames()).write.parquet(path)
    spark.sql(f"ALTER TABLE {database}.{name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(f"{database}.{name}")
    return path


def _new_version(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}/{uuid.uuid4().hex}"
