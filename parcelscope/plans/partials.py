"""Top lists, totals and averages of a window from stored monthly partials and the rows of its two edge months.

A partial is a count that adds up: per month and cities, and per month and shipper. Batches of new shipments append
theirs. A question over a date window adds up the partials of the months wholly inside it and counts only the rows of
the first and last month, and those whose date names no month, which any window may hold. The answers are those of
``analytics`` and ``reports``, exactly; only ``top_customers`` with ``approximate`` estimates the distinct consignees, from sketches
that merge, with a relative standard error of 1.04 / sqrt(2 ** ``SKETCH_BITS``), 1.6 %.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import has_digit
from ..functions.dates import OTHER_MONTH
from ..operators.aggregates import most_first, with_share
from ..operators.filters import present
from ..operators.windows import DateWindow, date_window, in_window
from ..sources import normalise

SKETCH_BITS = 12
MONTH = "creation_month"


class Partials(NamedTuple):
    """Partials of all stored shipments, and the shipments themselves for the edges of a window."""

    rows: DataFrame
    cities: DataFrame
    customers: DataFrame
    sketches: DataFrame


def city_partials(df: DataFrame) -> DataFrame:
    """Per month, origin and destination: rows, rows with a weight text that holds a digit, readable weights and their sum."""
    digit = has_digit(F.col("shipment_weight"))
    weight = F.when(digit, F.col("weight_kg"))
    return normalise(df).groupBy(MONTH, "shipper_city", "consignee_city").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(digit).alias("with_digit"),
        F.count(weight).alias("weighed"),
        F.sum(weight).cast("decimal(38,4)").alias("kg"),
    )


def customer_partials(df: DataFrame) -> DataFrame:
    """Per month, shipper and consignee: rows and the smallest phone."""
    named = normalise(df).where(present(F.col("shipper_name")))
    return named.groupBy(MONTH, "shipper_name", "consignee_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("shipper_phone").alias("phone")
    )


def customer_sketches(df: DataFrame) -> DataFrame:
    """Per month and shipper: rows, the smallest phone and a sketch of the consignees."""
    named = normalise(df).where(present(F.col("shipper_name")))
    return named.groupBy(MONTH, "shipper_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("shipper_phone").alias("phone"),
        F.hll_sketch_agg("consignee_name", F.lit(SKETCH_BITS)).alias("consignees"),
    )


_KINDS = {"cities": city_partials, "customers": customer_partials, "sketches": customer_sketches}
_SCHEMAS = {
    "cities": f"{MONTH} string, shipper_city string, consignee_city string, n long, with_digit long, weighed long, kg decimal(38,4)",
    "customers": f"{MONTH} string, shipper_name string, consignee_name string, n long, phone string",
    "sketches": f"{MONTH} string, shipper_name string, n long, phone string, consignees binary",
}


def add_partials(batch: DataFrame, path: str) -> None:
    """Appends the partials of new shipments. Run it once per batch, as the shipments themselves are appended."""
    for name, build in _KINDS.items():
        build(batch).write.mode("append").partitionBy(MONTH).parquet(f"{path}/{name}")


def load_partials(spark: SparkSession, path: str, rows: DataFrame) -> Partials:
    return Partials(rows, **{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS.items()})


def _in(partials: Partials, kind: str, window: DateWindow | None) -> DataFrame:
    """Partials of a window: stored ones of its inner months, fresh ones of the rows at its edges."""
    stored: DataFrame = getattr(partials, kind)
    if window is None:
        return stored
    first, last = window.start[:6], window.end[:6]
    month = F.col(MONTH)
    inner = stored.where((month != OTHER_MONTH) & (month > first) & (month < last))
    edges = normalise(partials.rows).where(month.isin(first, last, OTHER_MONTH) & in_window(window))
    build: Callable[[DataFrame], DataFrame] = _KINDS[kind]
    return inner.unionByName(build(edges).select(*stored.columns))


def by_city(partials: Partials, date_filter: str | None = "month", limit: int = 20, as_of: date | None = None) -> DataFrame:
    counts = _in(partials, "cities", date_window(date_filter, as_of)).groupBy(F.col("consignee_city").alias("city"))
    return most_first(counts.agg(F.sum("n").alias("shipment_count")), limit=limit)


def top_cities(
    partials: Partials, limit: int = 10, date_filter: str | None = "month", as_of: date | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    found = _in(partials, "cities", date_window(date_filter, as_of, start, end)).where(present(F.col("consignee_city"), null_words=("NULL",)))
    return most_first(found.groupBy(F.col("consignee_city").alias("city")).agg(F.sum("n").alias("shipment_count")), limit=limit)


def total_shipments(
    partials: Partials, date_filter: str | None = "month", as_of: date | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    found = _in(partials, "cities", date_window(date_filter, as_of, start, end))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def average_weight(
    partials: Partials, date_filter: str | None = None, as_of: date | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    found = _in(partials, "cities", date_window(date_filter, as_of, start, end))
    return found.agg(
        F.round(F.sum("kg").cast("double") / F.sum("weighed"), 6).alias("average_weight"),
        F.coalesce(F.sum("with_digit"), F.lit(0)).alias("total_shipments"),
    )


def top_customers(
    partials: Partials,
    limit: int = 10,
    date_filter: str | None = None,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Distinct consignees are exact unless ``approximate``, which reads one sketch per shipper and month instead of all pairs."""
    window = date_window(date_filter, as_of, start, end)
    if approximate:
        found = _in(partials, "sketches", window)
        distinct = F.hll_sketch_estimate(F.hll_union_agg("consignees"))
    else:
        found = _in(partials, "customers", window)
        pairs = found.groupBy("shipper_name", "consignee_name").agg(F.sum("n").alias("n"), F.min("phone").alias("phone"))
        found, distinct = pairs, F.count("consignee_name")
    facts = found.groupBy("shipper_name").agg(
        F.min("phone").alias("shipper_phone"), F.sum("n").alias("shipment_count"), distinct.alias("unique_consignees")
    )
    return most_first(facts, limit=limit)


def top20_cities(partials: Partials, limit: int = 20) -> DataFrame:
    found = partials.cities.where(F.col("consignee_city").isNotNull()).groupBy(F.col("consignee_city").alias("City"))
    counts = most_first(found.agg(F.sum("n").alias("Total Shipments")), "Total Shipments", limit)
    return with_share(counts, partials.cities.agg(F.sum("n")).scalar(), "Total Shipments")


def city_routes(partials: Partials, limit: int = 20) -> DataFrame:
    found = partials.cities.where(F.col("shipper_city").isNotNull() & F.col("consignee_city").isNotNull())
    routes = found.groupBy(F.col("shipper_city").alias("Origin"), F.col("consignee_city").alias("Destination"))
    return most_first(routes.agg(F.sum("n").alias("Shipments")), "Shipments", limit)
