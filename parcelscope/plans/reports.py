"""The predefined reports, as functions over shipments. ``CATALOGUE`` lists them with their SQL for stored use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as N
from ..functions.classes import SAL_PATTERN
from ..operators.aggregates import count_by, grand_total, most_first, with_share
from ..operators.filters import contains_like, matches
from ..operators.windows import created_from, date_window, in_window
from ..sources import normalise

_DATE = "shipment_creation_date"


def _monthly(rows: DataFrame, name: str) -> DataFrame:
    """Counts per raw month and year, so that months in unknown spelling stay apart, labelled ``MM-20YY``."""
    dated = F.col(_DATE)
    counts = count_by(rows, N.dmy_year(dated).alias("yy"), N.dmy_month(dated).alias("mon"), name=name)
    label = F.concat(N.month_number(F.col("mon")), F.lit("-20"), F.col("yy")).alias("Month")
    ordered = counts.select(label, name).orderBy(F.desc_nulls_first("Month"), F.desc(name))
    return ordered


def monthly_by_phone(df: DataFrame, phone_number: str) -> DataFrame:
    return _monthly(df.where(contains_like(F.col("shipper_phone"), phone_number)), "Total Shipments")


def monthly_sal(df: DataFrame) -> DataFrame:
    return _monthly(df.where(matches(F.col("shipment_reference_number"), SAL_PATTERN)), "SAL Shipments")


def top20_cities(df: DataFrame, limit: int = 20) -> DataFrame:
    """Percentages are of all rows, also those without a city."""
    rows = df.where(F.col("consignee_city").isNotNull())
    counts = count_by(rows, F.col("consignee_city").alias("City"), name="Total Shipments")
    return with_share(most_first(counts, "Total Shipments", limit), grand_total(df), "Total Shipments")


def _top_shippers_since(rows: DataFrame, limit: int) -> DataFrame:
    keys = [F.col("shipper_phone").alias("Phone"), F.col("shipper_name").alias("Name")]
    return most_first(count_by(rows, *keys, name="Recent Shipments"), "Recent Shipments", limit)


def top15_shippers(df: DataFrame, since: str = "01-Oct-25", limit: int = 15) -> DataFrame:
    """Compares the date as text, as stored report texts do; see :func:`top15_shippers_by_date`."""
    return _top_shippers_since(df.where(F.col(_DATE) >= since), limit)


def top15_shippers_by_date(df: DataFrame, as_of: date | None = None, limit: int = 15) -> DataFrame:
    """The last 30 days by normalised date."""
    return _top_shippers_since(normalise(df).where(in_window(date_window("month", as_of))), limit)


def weight_distribution(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("shipment_weight").isNotNull())
    counts = count_by(rows, N.weight_band(F.col("shipment_weight")).alias("Weight Range"), name="Count")
    return most_first(counts, "Count")


def weight_distribution_kg(df: DataFrame) -> DataFrame:
    """The same bands over parsed weights."""
    rows = normalise(df).where(F.col("weight_kg").isNotNull())
    return most_first(count_by(rows, N.weight_band_kg(F.col("weight_kg")).alias("Weight Range"), name="Count"), "Count")


def daily_volume(df: DataFrame, year: str = "25", limit: int = 30) -> DataFrame:
    """Dates of one year, the largest text first; see :func:`daily_volume_by_date`."""
    rows = df.where(matches(F.col(_DATE), rf"\d{{2}}-[A-Za-z]{{3}}-{year}\z"))
    counts = count_by(rows, F.col(_DATE).alias("Date"), name="Shipments")
    return counts.orderBy(F.desc("Date")).limit(limit)


def daily_volume_by_date(df: DataFrame, as_of: date | None = None) -> DataFrame:
    """The last 30 days by normalised date."""
    rows = normalise(df).where(in_window(date_window("month", as_of)))
    return count_by(rows, F.col("creation_ymd").alias("Date"), name="Shipments").orderBy(F.desc("Date"))


def _of_shipper(df: DataFrame, phone_number: str) -> DataFrame:
    return df.where(contains_like(F.col("shipper_phone"), phone_number))


def _shipper_keys() -> list[Column]:
    return [F.col("shipper_phone").alias("Phone"), F.col("shipper_name").alias("Name")]


def shipper_cities_served(df: DataFrame, phone_number: str) -> DataFrame:
    return (
        _of_shipper(df, phone_number)
        .groupBy(*_shipper_keys())
        .agg(
            F.count(F.lit(1)).alias("Total Shipments"),
            F.countDistinct("consignee_city").alias("Cities Served"),
        )
    )


def _distribution(df: DataFrame, label: Column, name: str) -> DataFrame:
    counts = count_by(df, label.alias(name), name="Count")
    return with_share(most_first(counts, "Count"), grand_total(df), "Count")


def phone_patterns(df: DataFrame) -> DataFrame:
    return _distribution(df, N.phone_type(F.col("shipper_phone")), "Phone Type")


def city_routes(df: DataFrame, limit: int = 20) -> DataFrame:
    ends = [F.col("shipper_city").alias("Origin"), F.col("consignee_city").alias("Destination")]
    rows = df.where(F.col("shipper_city").isNotNull() & F.col("consignee_city").isNotNull())
    return most_first(count_by(rows, *ends, name="Shipments"), "Shipments", limit)


def reference_types(df: DataFrame) -> DataFrame:
    return _distribution(df, N.reference_type(F.col("shipment_reference_number")), "Pattern Type")


def shipper_top_cities(df: DataFrame, phone_number: str, limit: int = 10) -> DataFrame:
    """Percentages are of all rows of the phone, also those without a city."""
    counts = count_by(_of_shipper(df, phone_number), F.col("consignee_city").alias("City"), name="Shipments")
    # The whole is summed up from the same counts. The rows without a city are one group of them and are left out
    # behind the limit: a filter in front of it would move below the counts, and the rows would be read twice.
    whole = counts.agg(F.sum("Shipments")).scalar()
    named = most_first(counts, "Shipments", limit + 1).where(F.col("City").isNotNull())
    return with_share(most_first(named, "Shipments", limit), whole, "Shipments")


def multi_box(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("number_of_shipment_boxes").isNotNull())
    counts = count_by(rows, F.col("number_of_shipment_boxes").alias("Boxes"), name="Shipments")
    ordered = counts.orderBy(F.asc_nulls_last(N.boxes_int(F.col("Boxes"))), F.asc("Boxes"))
    return with_share(ordered, grand_total(df), "Shipments")


def top_shippers(df: DataFrame, limit: int = 25) -> DataFrame:
    keys = [*_shipper_keys(), F.col("shipper_city").alias("City")]
    return most_first(count_by(df, *keys, name="Total Shipments"), "Total Shipments", limit)


def shippers_to_city(df: DataFrame, city_name: str, limit: int = 20) -> DataFrame:
    keys = [F.col("shipper_name").alias("Shipper"), F.col("shipper_phone").alias("Phone")]
    name = f"Shipments to {city_name}"
    return most_first(count_by(df.where(F.col("consignee_city") == city_name), *keys, name=name), name, limit)


def shipper_summary(df: DataFrame, phone_number: str) -> DataFrame:
    """First and last date by text; see :func:`shipper_summary_by_date`."""
    return _summary(_of_shipper(df, phone_number), _DATE)


def shipper_summary_by_date(df: DataFrame, phone_number: str) -> DataFrame:
    """First and last real date."""
    return _summary(_of_shipper(normalise(df), phone_number), "creation_date")


def _summary(rows: DataFrame, dated: str) -> DataFrame:
    day = F.date_format(dated, "yyyy-MM-dd") if dated == "creation_date" else F.col(dated)
    return rows.groupBy(*_shipper_keys()).agg(
        F.count(F.lit(1)).alias("Total Shipments"),
        F.countDistinct("consignee_city").alias("Cities"),
        F.min(day).alias("First Ship"),
        F.max(day).alias("Last Ship"),
    )


@dataclass(frozen=True)
class Report:
    """A predefined report: its id, its function, and its SQL over the view ``shipments`` with example parameters."""

    id: str
    run: Callable[..., DataFrame]
    sql_query: str
    columns: tuple[str, ...]
    required: dict = field(default_factory=dict)


_SHARE = "CAST(round(100.0BD * count(*) / (SELECT count(*) FROM shipments), 2) AS DOUBLE)"

# Ids, column names and example parameters of the reports.
CATALOGUE: tuple[Report, ...] = (
    Report(
        "monthly_shipments_by_phone",
        monthly_by_phone,
        """SELECT first(month_label) AS `Month`, count(*) AS `Total Shipments` FROM shipments
        WHERE shipper_phone LIKE concat('%', :phone_number, '%') GROUP BY year_2, month_name
        ORDER BY `Month` DESC NULLS FIRST, `Total Shipments` DESC""",
        ("Month", "Total Shipments"),
        {"phone_number": "800"},
    ),
    Report(
        "shipments_by_sal_pattern",
        monthly_sal,
        """SELECT first(month_label) AS `Month`, count(*) AS `SAL Shipments` FROM shipments
        WHERE reference_type = 'SAL Pattern' GROUP BY year_2, month_name
        ORDER BY `Month` DESC NULLS FIRST, `SAL Shipments` DESC""",
        ("Month", "SAL Shipments"),
    ),
    Report(
        "top_20_destination_cities",
        top20_cities,
        f"""SELECT consignee_city AS City, count(*) AS `Total Shipments`, {_SHARE} AS Percentage FROM shipments
        WHERE consignee_city IS NOT NULL GROUP BY City ORDER BY `Total Shipments` DESC, City LIMIT 20""",
        ("City", "Total Shipments", "Percentage"),
    ),
    Report(
        "top_15_active_shippers",
        top15_shippers,
        """SELECT shipper_phone AS Phone, shipper_name AS Name, count(*) AS `Recent Shipments` FROM shipments
        WHERE shipment_creation_date >= '01-Oct-25' GROUP BY Phone, Name
        ORDER BY `Recent Shipments` DESC, Phone NULLS LAST, Name NULLS LAST LIMIT 15""",
        ("Phone", "Name", "Recent Shipments"),
    ),
    Report(
        "shipment_distribution_by_weight",
        weight_distribution,
        """SELECT weight_band AS `Weight Range`, count(*) AS `Count` FROM shipments
        WHERE shipment_weight IS NOT NULL GROUP BY weight_band ORDER BY `Count` DESC, `Weight Range`""",
        ("Weight Range", "Count"),
    ),
    Report(
        "daily_shipment_volume",
        daily_volume,
        r"""SELECT shipment_creation_date AS Date, count(*) AS Shipments FROM shipments
        WHERE shipment_creation_date RLIKE r'\d{2}-[A-Za-z]{3}-25\z' GROUP BY Date ORDER BY Date DESC LIMIT 30""",
        ("Date", "Shipments"),
    ),
    Report(
        "shipper_performance_cities",
        shipper_cities_served,
        """SELECT shipper_phone AS Phone, shipper_name AS Name, count(*) AS `Total Shipments`,
        count(DISTINCT consignee_city) AS `Cities Served` FROM shipments
        WHERE shipper_phone LIKE concat('%', :phone_number, '%') GROUP BY Phone, Name""",
        ("Phone", "Name", "Total Shipments", "Cities Served"),
        {"phone_number": "800"},
    ),
    Report(
        "phone_number_pattern_analysis",
        phone_patterns,
        f"""SELECT phone_type AS `Phone Type`, count(*) AS `Count`, {_SHARE} AS Percentage FROM shipments
        GROUP BY phone_type ORDER BY `Count` DESC, `Phone Type`""",
        ("Phone Type", "Count", "Percentage"),
    ),
    Report(
        "city_to_city_routes",
        city_routes,
        """SELECT shipper_city AS Origin, consignee_city AS Destination, count(*) AS Shipments FROM shipments
        WHERE shipper_city IS NOT NULL AND consignee_city IS NOT NULL GROUP BY Origin, Destination
        ORDER BY Shipments DESC, Origin, Destination LIMIT 20""",
        ("Origin", "Destination", "Shipments"),
    ),
    Report(
        "reference_number_type_distribution",
        reference_types,
        f"""SELECT reference_type AS `Pattern Type`, count(*) AS `Count`, {_SHARE} AS Percentage FROM shipments
        GROUP BY reference_type ORDER BY `Count` DESC, `Pattern Type`""",
        ("Pattern Type", "Count", "Percentage"),
    ),
    Report(
        "specific_shipper_top_cities",
        shipper_top_cities,
        """WITH own AS (SELECT consignee_city FROM shipments WHERE shipper_phone LIKE concat('%', :phone_number, '%'))
        SELECT consignee_city AS City, count(*) AS Shipments,
        CAST(round(100.0BD * count(*) / (SELECT count(*) FROM own), 2) AS DOUBLE) AS Percentage
        FROM own WHERE consignee_city IS NOT NULL GROUP BY City ORDER BY Shipments DESC, City LIMIT 10""",
        ("City", "Shipments", "Percentage"),
        {"phone_number": "9200"},
    ),
    Report(
        "multi_box_shipments_analysis",
        multi_box,
        f"""SELECT number_of_shipment_boxes AS Boxes, count(*) AS Shipments, {_SHARE} AS Percentage FROM shipments
        WHERE number_of_shipment_boxes IS NOT NULL GROUP BY number_of_shipment_boxes
        ORDER BY try_cast(number_of_shipment_boxes AS INT) NULLS LAST, number_of_shipment_boxes""",
        ("Boxes", "Shipments", "Percentage"),
    ),
    Report(
        "top_shippers_by_total_shipments",
        top_shippers,
        """SELECT shipper_phone AS Phone, shipper_name AS Name, shipper_city AS City, count(*) AS `Total Shipments`
        FROM shipments GROUP BY Phone, Name, City
        ORDER BY `Total Shipments` DESC, Phone NULLS LAST, Name NULLS LAST, City NULLS LAST LIMIT 25""",
        ("Phone", "Name", "City", "Total Shipments"),
    ),
    Report(
        "shipments_by_specific_city",
        shippers_to_city,
        """SELECT shipper_name AS Shipper, shipper_phone AS Phone, count(*) AS `Shipments to {city_name}`
        FROM shipments WHERE consignee_city = :city_name GROUP BY Shipper, Phone
        ORDER BY count(*) DESC, Shipper NULLS LAST, Phone NULLS LAST LIMIT 20""",
        ("Shipper", "Phone", "Shipments to {city_name}"),
        {"city_name": "NATION_3"},
    ),
    Report(
        "comprehensive_shipper_summary",
        shipper_summary,
        """SELECT shipper_phone AS Phone, shipper_name AS Name, count(*) AS `Total Shipments`,
        count(DISTINCT consignee_city) AS Cities, min(shipment_creation_date) AS `First Ship`,
        max(shipment_creation_date) AS `Last Ship` FROM shipments
        WHERE shipper_phone LIKE concat('%', :phone_number, '%') GROUP BY Phone, Name""",
        ("Phone", "Name", "Total Shipments", "Cities", "First Ship", "Last Ship"),
        {"phone_number": "+966"},
    ),
)

BY_ID = {report.id: report for report in CATALOGUE}
