"""The normalised layer: untidy text columns turned into typed ones once, when shipments are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as N

DERIVED_COLUMNS = ("creation_ymd", "creation_date", "creation_month", "weight_kg", "cod_amount")
IDS_PER_FILE = 4_000_000


def normalise(df: DataFrame) -> DataFrame:
    """Adds the derived columns; a frame that has them already comes back as it is."""
    if set(DERIVED_COLUMNS) <= set(df.columns):
        return df
    return _with_numbers(_with_month(df))


def _with_month(df: DataFrame) -> DataFrame:
    dated = df.withColumn("creation_ymd", N.creation_ymd(F.col("shipment_creation_date")))
    return dated.withColumn("creation_month", N.creation_month(F.col("creation_ymd")))


def _with_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "creation_date": N.creation_day(F.col("creation_ymd")),
            "weight_kg": N.parse_amount(F.col("shipment_weight")),
            "cod_amount": N.parse_amount(F.col("cod")),
        }
    )


def with_classes(df: DataFrame) -> DataFrame:
    """The view that stored SQL reads: normalised columns and the classes that reports group by.

    The classes are expressions, not stored columns; a query that uses none of them does not compute any.
    """
    dated = F.col("shipment_creation_date")
    return normalise(df).withColumns(
        {
            "phone_type": N.phone_type(F.col("shipper_phone")),
            "reference_type": N.reference_type(F.col("shipment_reference_number")),
            "weight_band": N.weight_band(F.col("shipment_weight")),
            "boxes": N.boxes_int(F.col("number_of_shipment_boxes")),
            "month_name": N.dmy_month(dated),
            "year_2": N.dmy_year(dated),
            "month_label": N.month_label(dated),
        }
    )


def write_normalised(df: DataFrame, path: str, tasks: int) -> None:
    """Stores normalised shipments by creation month, sorted by id inside each file.

    Rows are spread by month and range of ids, in one pass and without sampling: a month with a third of all rows is
    written by many tasks, no pair holds more than ``IDS_PER_FILE`` rows, and id filters skip row groups. Only the month
    is derived before the rows move; the numbers are parsed where they are written.
    """
    spread = _with_month(df).repartition(tasks, "creation_month", F.expr(f"id div {IDS_PER_FILE}"))
    _with_numbers(spread).sortWithinPartitions("creation_month", "id").write.partitionBy("creation_month").parquet(path)
