"""Export to CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import clean_text

# How the export writes. Spark would trim values unless told not to.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


ROWS_PER_PART = 100_000


def export_csv(df: DataFrame, path: str) -> Observation:
    """Writes rows as UTF-8 CSV with a header line in every part, quotes doubled, NULL and '' both empty.

    Each task writes its own part. Returns an observation whose ``records`` were counted during the write.
    """
    counted = Observation()
    rows = df.select(*[_as_written(name, kind) for name, kind in df.dtypes])
    rows = rows.observe(counted, F.count(F.lit(1)).alias("records"))
    rows.write.options(**CSV_OPTIONS).csv(path)
    return counted


def export_csv_parts(df: DataFrame, path: str, order: str = "id", tasks: int | None = None) -> None:
    """The same as parts that, put one after the other in the order of their names, are one valid CSV file.

    The first part is the header line; rows follow in the order of a column, each range of it written by a task of its own.
    Unless told otherwise there are as many ranges as keep what a task sorts at ``ROWS_PER_PART`` rows, for which the rows are counted.
    """
    spark = df.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PART))
    names = ",".join(name if name.isidentifier() else '"' + name.replace('"', '""') + '"' for name in df.columns)
    header = spark.range(0, 1, 1, 1).select(F.lit(names).alias("value"))
    options = {key: str(value).lower() if isinstance(value, bool) else value for key, value in CSV_OPTIONS.items() if key != "header"}
    written = F.struct(*[_as_written(name, kind) for name, kind in df.dtypes])
    # a row of one empty column would be an empty line, which readers skip
    line = F.to_csv(written, options)
    line = F.when(line == "", F.lit('""')).otherwise(line)
    rows = df.repartitionByRange(tasks, order).sortWithinPartitions(order).select(line.alias("value"))
    header.union(rows).write.text(path)


def _as_written(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind == "boolean":
        column = F.when(column, "True").when(~column, "False")
    elif kind.startswith(("array", "map", "struct")):
        column = F.to_json(column)
    return column.alias(name)


def export_summary(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows and returns one row: format and number of records, from the write itself."""
    records = export_csv(df, path).get["records"]
    return df.sparkSession.range(1).select(F.lit("csv").alias("format"), F.lit(records).cast("long").alias("records"))


def clean_for_display(df: DataFrame) -> DataFrame:
    """Every text column cleaned for display; other columns as they are."""
    return df.select(*[clean_text(F.col(f"`{n}`")).alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in df.dtypes])
