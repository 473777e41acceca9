"""Top lists, averages and totals over the rows created inside a window; without a window, over all rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import has_digit
from ..operators.aggregates import average_of, completeness, count_by, customer_stats, most_first, sample_groups, total
from ..operators.filters import present
from ..operators.windows import date_window, in_window
from ..sources import normalise

CITY = "consignee_city"


def _scope(
    df: DataFrame, date_filter: str | None, as_of: date | None, start: str | None, end: str | None
) -> DataFrame:
    window = date_window(date_filter, as_of, start, end)
    return df if window is None else normalise(df).where(in_window(window))


def _has_city() -> Column:
    return present(F.col(CITY), null_words=("NULL",))


def top_customers(
    df: DataFrame,
    limit: int = 10,
    date_filter: str | None = None,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    rows = _scope(df, date_filter, as_of, start, end).where(present(F.col("shipper_name")))
    return most_first(customer_stats(rows), limit=limit)


def by_city(
    df: DataFrame, date_filter: str | None = "month", limit: int = 20, as_of: date | None = None
) -> DataFrame:
    """Rows per consignee city; rows without a city count as a city of their own."""
    rows = normalise(df).where(in_window(date_window(date_filter, as_of)))
    return most_first(count_by(rows, F.col("consignee_city").alias("city")), limit=limit)


def average_weight(
    df: DataFrame,
    date_filter: str | None = None,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Average of the parsed weights beside the number of rows whose weight text holds a digit."""
    rows = _scope(normalise(df), date_filter, as_of, start, end).where(has_digit(F.col("shipment_weight")))
    return average_of(rows, "weight_kg", "average_weight", "total_shipments")


def total_shipments(
    df: DataFrame,
    date_filter: str | None = "month",
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Rows of a window, or all rows for ``total``; custom bounds come first."""
    return total(_scope(df, date_filter, as_of, start, end))


def top_cities(
    df: DataFrame,
    limit: int = 10,
    date_filter: str | None = "month",
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    rows = _scope(df, date_filter, as_of, start, end).where(_has_city())
    return most_first(count_by(rows, F.col(CITY).alias("city")), limit=limit)


def customer_sample(df: DataFrame) -> DataFrame:
    return sample_groups(df, "shipper_name")


def city_completeness(df: DataFrame) -> DataFrame:
    """Sample cities, each beside the counts of rows with a city and with a non-empty one."""
    city = F.col("consignee_city")
    facts = completeness(df, "consignee_city")
    samples = sample_groups(df.where(present(city)), "consignee_city")
    return samples.select(
        facts.select("total_with_value").scalar().alias("total_with_city"),
        facts.select("non_empty").scalar().alias("non_empty_cities"),
        city.alias("sample_city"),
        F.col("count").alias("sample_count"),
    )


def analytics_summary(
    df: DataFrame,
    date_filter: str | None = "month",
    cities: int = 5,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row: total, average weight and the top cities as an array, all from one count per city over one window."""
    rows = _scope(normalise(df), date_filter, as_of, start, end)
    weight = F.when(has_digit(F.col("shipment_weight")), F.col("weight_kg"))
    per_city = rows.groupBy(F.col(CITY)).agg(
        F.count(F.lit(1)).alias("shipment_count"), F.sum(weight).alias("kg"), F.count(weight).alias("weighed")
    )
    facts = per_city.agg(
        F.coalesce(F.sum("shipment_count"), F.lit(0)).alias("total_shipments"),
        F.round(F.sum("kg").cast("double") / F.sum("weighed"), 6).alias("average_weight"),
    )
    top = most_first(per_city.where(_has_city()).select(F.col(CITY).alias("city"), "shipment_count"), limit=cities)
    # At most ``cities`` rows come together here.
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("shipment_count")).alias("order"), "city"))),
        lambda x: F.struct((-x["order"]).alias("shipment_count"), x["city"].alias("city")),
    )
    return top.agg(listed.alias("top_cities")).select(
        facts.select("total_shipments").scalar().alias("total_shipments"),
        facts.select("average_weight").scalar().alias("average_weight"),
        "top_cities",
    )


def analytics_summary_flat(df: DataFrame, **options) -> DataFrame:
    """The same with one row per city."""
    summary = analytics_summary(df, **options)
    return summary.select(
        "total_shipments", "average_weight", F.explode_outer("top_cities").alias("top")
    ).select("total_shipments", "average_weight", "top.city", "top.shipment_count")
