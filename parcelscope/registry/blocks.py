"""Windows, projections, predicates, joins, aggregates and orders (D, P, F, J, A, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import paging
from ..operators.windows import (
    DAYS_BACK,
    calendar_range,
    date_window,
    id_window,
    in_window,
    latest_n,
)
from ..plans import stored
from ..sources import sample
from ..sources.sample import shipments
from .base import AS_OF, register
from .oracle import SHIPMENT_COLUMNS, over_shipments, over_tables

MONTH = ("20250702", "20250801")
IN_MONTH = "creation_ymd >= '20250702' AND creation_ymd <= '20250801'"


def _windows(**bounds: tuple[str, str] | None) -> str:
    return over_shipments(
        " UNION ALL ".join(
            f"SELECT '{name}' AS preset, count(*)::BIGINT AS rows FROM ship WHERE "
            + (f"creation_ymd >= '{at[0]}' AND creation_ymd <= '{at[1]}'" if at else "true")
            for name, at in bounds.items()
        )
    )


def _count_each(df, conditions: dict):
    """Rows that meet each condition, in one pass, as (preset, rows)."""
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])
    return counts.unpivot([], list(conditions), "preset", "rows")


@register(
    "d01_preset_windows",
    _windows(
        today=("20250801", "20250801"),
        week=("20250725", "20250801"),
        month=MONTH,
        year=("20240801", "20250801"),
        total=None,
    ),
)
def d01(spark, sf):
    return _count_each(
        shipments(spark, sf), {name: in_window(date_window(name, AS_OF)) for name in (*DAYS_BACK, "total")}
    )


@register("d02_one_day", over_shipments("SELECT id, creation_ymd FROM ship WHERE creation_ymd BETWEEN '20250301' AND '20250302'"))
def d02(spark, sf):
    return shipments(spark, sf).where(in_window(date_window("2025-03-01", AS_OF))).select("id", "creation_ymd")


@register("d03_custom_range", over_shipments("SELECT id, creation_ymd FROM ship WHERE creation_ymd BETWEEN '20230115' AND '20230420'"))
def d03(spark, sf):
    window = date_window("week", AS_OF, start="2023-01-15", end="2023-04-20")
    return shipments(spark, sf).where(in_window(window)).select("id", "creation_ymd")


@register(
    "d04_calendar_ranges",
    _windows(
        today=("20250801", "20250801"),
        yesterday=("20250731", "20250731"),
        this_week=("20250728", "20250801"),
        this_month=("20250801", "20250801"),
        custom=("20250601", "20250630"),
    ),
)
def d04(spark, sf):
    kinds = ("today", "yesterday", "this_week", "this_month", "custom")
    ranges = {kind: calendar_range(kind, AS_OF, "2025-06-01", "2025-06-30") for kind in kinds}
    windows = {kind: date_window(start=str(first), end=str(last)) for kind, (first, last) in ranges.items()}
    return _count_each(shipments(spark, sf), {kind: in_window(window) for kind, window in windows.items()})


@register("d05_id_window", over_shipments("SELECT id, creation_ymd FROM ship WHERE id > (SELECT max(id) - 24000 FROM ship)"))
def d05(spark, sf):
    return id_window(shipments(spark, sf), 24_000).select("id", "creation_ymd")


@register("d06_latest_n_counted", over_shipments("SELECT id, creation_ymd FROM ship ORDER BY id DESC LIMIT 777"))
def d06_counted(spark, sf):
    """The border of the newest rows from the counts stored beside the shipments."""
    return latest_n(shipments(spark, sf), 777, sample.shipment_counts(spark, sf)).select("id", "creation_ymd")


@register("d06_latest_n", over_shipments("SELECT id, creation_ymd FROM ship ORDER BY id DESC LIMIT 2400"))
def d06(spark, sf):
    return latest_n(shipments(spark, sf), 2_400).select("id", "creation_ymd")


@register(
    "p01_select_all",
    over_shipments(
        f"SELECT {SHIPMENT_COLUMNS}, creation_ymd, weight_kg::DOUBLE AS weight_kg, cod_amount::DOUBLE AS cod_amount, "
        "CASE WHEN regexp_matches(creation_ymd, '^20[0-9]{2}(0[1-9]|1[0-2])') THEN substr(creation_ymd, 1, 6) "
        "ELSE 'other' END AS creation_month, strftime(TRY_CAST(CASE WHEN regexp_matches(creation_ymd, '^[0-9]{8}$') "
        "THEN substr(creation_ymd, 1, 4) || '-' || substr(creation_ymd, 5, 2) || '-' || substr(creation_ymd, 7, 2) END "
        "AS DATE), '%Y-%m-%d') AS creation_date FROM ship"
    ),
)
def p01(spark, sf):
    return shipments(spark, sf).withColumns(
        {
            "creation_date": F.date_format("creation_date", "yyyy-MM-dd"),
            "weight_kg": F.col("weight_kg").cast("double"),
            "cod_amount": F.col("cod_amount").cast("double"),
        }
    )


@register("p02_project", over_shipments("SELECT id, consignee_city, shipment_weight FROM ship"))
def p02(spark, sf):
    return P.project(shipments(spark, sf), ["id", "consignee_city", "shipment_weight"])


@register(
    "p03_spaced_aliases",
    over_shipments(
        'SELECT shipper_phone AS "Phone Number", count(*)::BIGINT AS "Total Shipments" FROM ship GROUP BY 1'
    ),
)
def p03(spark, sf):
    return A.count_by(shipments(spark, sf), F.col("shipper_phone").alias("Phone Number"), name="Total Shipments")


def _where(key: str, sql: str, columns: str, *conditions, derived=None):
    """Registers a filter: the named columns of all rows that meet the conditions."""

    @register(key, over_shipments(f"SELECT {derived or columns} FROM ship WHERE {sql}"))
    def run(spark, sf):
        return shipments(spark, sf).where(P.all_of(make() for make in conditions)).selectExpr(*columns.split(", "))

    return run


_where(
    "f01_contains_like",
    "shipper_name LIKE '%00_5%'",
    "id, shipper_name",
    lambda: P.contains_like(F.col("shipper_name"), "00_5"),
)
_where(
    "f01_contains_literal",
    "contains(shipment_reference_number, 'REF_1')",
    "id, shipment_reference_number",
    lambda: P.contains_like(F.col("shipment_reference_number"), "REF_1", literal=True),
)


@register("f02_any_column", over_shipments("SELECT id, shipper_city FROM ship WHERE id::VARCHAR LIKE '%77%'"))
def f02(spark, sf):
    return P.filter_by(shipments(spark, sf), "id", "77").select("id", "shipper_city")


_where(
    "f03_equality",
    "country_code = 'AE' AND TRY_CAST(number_of_shipment_boxes AS INT) = 4",
    "id, country_code, number_of_shipment_boxes",
    lambda: P.all_of(P.search_conditions(country_code="AE", number_of_boxes="4")),
)
_where("f04_in_window", IN_MONTH, "id, creation_ymd", lambda: in_window(date_window("month", AS_OF)))
_where(
    "f05_from_only",
    "creation_ymd >= '20250601'",
    "id, creation_ymd",
    lambda: P.all_of(P.search_conditions(creation_date_from="2025-06-01")),
)
_where(
    "f05_to_only",
    "creation_ymd <= '20190331'",
    "id, creation_ymd",
    lambda: P.all_of(P.search_conditions(creation_date_to="20190331")),
)
_where(
    "f06_processing_dates",
    "processing_date >= '2024-02-01' AND processing_date <= '2024-03-15'",
    "id, processing_date",
    lambda: P.all_of(P.processing_between("2024-02-01", "2024-03-15")),
)
_where(
    "f07_weight_between",
    "weight_kg >= 0.5 AND weight_kg <= 3",
    "id, shipment_weight",
    lambda: P.all_of(P.weight_between("0.5", 3)),
)
_where(
    "f07_weight_bad_bound",
    "weight_kg <= 0.3",
    "id, shipment_weight",
    lambda: P.all_of(P.weight_between("heavy", "0.3")),
)
_where("f08_weight_above", "weight_kg > 20", "id, shipment_weight", lambda: P.weight_above(20))
_where("f09_cod_yes", "cod_amount > 0", "id, cod", lambda: P.cod_is("Yes"))
_where("f09_cod_no", "cod_amount = 0 OR cod_amount IS NULL", "id, cod", lambda: P.cod_is("no"))
_where(
    "f10_present",
    "shipper_name IS NOT NULL AND shipper_name <> ''",
    "id, shipper_name",
    lambda: P.present(F.col("shipper_name")),
)
_where(
    "f11_present_words",
    "consignee_city IS NOT NULL AND consignee_city <> '' AND consignee_city <> 'NULL'",
    "id, consignee_city",
    lambda: P.present(F.col("consignee_city"), ["NULL"]),
)
_where(
    "f12_matches",
    "regexp_matches(shipment_reference_number, '^SAL[0-9]+$')",
    "id, shipment_reference_number",
    lambda: P.matches(F.col("shipment_reference_number"), r"^SAL[0-9]+\z"),
)
_where(
    "f13_text_date",
    "shipment_creation_date >= '01-Oct-25'",
    "id, shipment_creation_date",
    lambda: F.col("shipment_creation_date") >= "01-Oct-25",
)

MANY = {
    "shipment_number": "SH0",
    "reference_number": "1",
    "country_code": "KW",
    "description": "-",
    "pdf_filename": "label",
    "creation_date_from": "2020-01-01",
    "creation_date_to": "2025-01-31",
    "processing_date_from": "2020-01-01",
    "processing_date_to": "2025-02-15",
    "min_weight": "0.2",
    "max_weight": "35",
    "cod": "yes",
    "shipper_name": "Supplier",
    "shipper_city": "NATION",
    "shipper_address": "Street",
    "consignee_name": "Customer",
    "consignee_city": "NATION_",
    "consignee_phone": "05",
    "consignee_address": "block",
}
MANY_SQL = """number_shipment LIKE '%SH0%' AND shipment_reference_number LIKE '%1%' AND country_code = 'KW'
    AND shipment_description LIKE '%-%' AND pdf_filename LIKE '%label%' AND creation_ymd >= '20200101'
    AND creation_ymd <= '20250131' AND processing_date >= '2020-01-01' AND processing_date <= '2025-02-15'
    AND weight_kg >= 0.2 AND weight_kg <= 35 AND cod_amount > 0 AND shipper_name LIKE '%Supplier%'
    AND shipper_city LIKE '%NATION%' AND shipper_address LIKE '%Street%' AND consignee_name LIKE '%Customer%'
    AND consignee_city LIKE '%NATION_%' AND consignee_phone LIKE '%05%' AND consignee_address LIKE '%block%'"""

_where(
    "f14_many_filters",
    MANY_SQL,
    "id, number_shipment, creation_ymd, cod",
    lambda: P.all_of(P.search_conditions(**MANY)),
)


@register(
    "f15_built_query",
    over_shipments(
        f"""SELECT id, shipper_city, consignee_city, shipment_weight FROM ship WHERE creation_ymd >= '20240801'
        AND creation_ymd <= '20250801' AND shipper_city LIKE '%NATION_1%' AND weight_kg >= 0.3 AND weight_kg <= 25
        """
    ),
)
def f15(spark, sf):
    filters = {
        "date_filter": "year",
        "shipper_city": "NATION_1",
        "min_weight": 0.3,
        "max_weight": "25",
        "not_a_filter": "ignored",
    }
    columns = ["id", "shipper_city", "consignee_city", "shipment_weight"]
    return P.build_query(shipments(spark, sf), filters, columns, AS_OF)


@register("f16_active", over_tables("dashboard_widgets", "SELECT * FROM dashboard_widgets WHERE is_active"))
def f16(spark, sf):
    return P.active(sample.dashboard_widgets(spark, sf))


_where(
    "f17_city_aliases",
    "shipper_city LIKE '%NATION_1%' AND consignee_city LIKE '%NATION_2%'",
    "id, shipper_city, consignee_city",
    lambda: P.all_of(P.search_conditions(from_city="NATION_1", to_city="NATION_2")),
)


@register(
    "j01_active_schedules",
    over_tables(
        "custom_reports scheduled_reports",
        """SELECT s.*, r.report_name AS report_title, r.description AS report_description
        FROM scheduled_reports s JOIN custom_reports r ON s.report_id = r.id WHERE s.is_active
        ORDER BY s.next_run_at NULLS LAST, s.created_at DESC NULLS FIRST, s.id""",
    ),
)
def j01(spark, sf):
    return stored.active_schedules(sample.scheduled_reports(spark, sf), sample.custom_reports(spark, sf))


@register(
    "j02_scalar_predicate",
    over_shipments(
        """SELECT consignee_city, count(*)::BIGINT AS shipment_count FROM ship
        WHERE id > (SELECT max(id) - 24000 FROM ship) GROUP BY 1"""
    ),
)
def j02(spark, sf):
    return A.count_by(id_window(shipments(spark, sf), 24000), "consignee_city")


@register(
    "j03_scalar_projection",
    over_shipments(
        """SELECT country_code, count(*)::BIGINT AS shipment_count,
        round(count(*) * 100.0 / (SELECT count(*) FROM ship WHERE shipper_city IS NOT NULL), 2)::DOUBLE AS share
        FROM ship WHERE shipper_city IS NOT NULL GROUP BY 1"""
    ),
)
def j03(spark, sf):
    rows = shipments(spark, sf).where(F.col("shipper_city").isNotNull())
    return A.with_share(A.count_by(rows, "country_code"), A.grand_total(rows), "shipment_count", "share")


@register("a01_total", over_shipments("SELECT count(*)::BIGINT AS total FROM ship"))
def a01(spark, sf):
    return A.total(shipments(spark, sf))


@register(
    "a02_count_by_city", over_shipments("SELECT shipper_city, count(*)::BIGINT AS shipment_count FROM ship GROUP BY 1")
)
def a02(spark, sf):
    return A.count_by(shipments(spark, sf), "shipper_city")


@register(
    "a03_count_by_route",
    over_shipments("SELECT shipper_city, consignee_city, count(*)::BIGINT AS shipment_count FROM ship GROUP BY 1, 2"),
)
def a03(spark, sf):
    return A.count_by(shipments(spark, sf), "shipper_city", "consignee_city")


@register(
    "a04_count_by_three_keys",
    over_shipments(
        """SELECT shipper_phone, shipper_name, shipper_city, count(*)::BIGINT AS shipment_count FROM ship
        GROUP BY 1, 2, 3"""
    ),
)
def a04(spark, sf):
    return A.count_by(shipments(spark, sf), "shipper_phone", "shipper_name", "shipper_city")


@register(
    "a05_count_by_expression",
    over_shipments(
        """SELECT substr(creation_ymd, 1, 4) AS year, coalesce(weight_kg > 1, false) AS heavy,
        count(*)::BIGINT AS shipment_count FROM ship GROUP BY 1, 2"""
    ),
)
def a05(spark, sf):
    heavy = F.coalesce(F.col("weight_kg") > 1, F.lit(False)).alias("heavy")
    return A.count_by(shipments(spark, sf), F.substring("creation_ymd", 1, 4).alias("year"), heavy)


@register(
    "a06_customer_stats",
    over_shipments(
        """SELECT shipper_name, min(shipper_phone) AS shipper_phone, count(*)::BIGINT AS shipment_count,
        count(DISTINCT consignee_name)::BIGINT AS unique_consignees FROM ship GROUP BY 1"""
    ),
)
def a06(spark, sf):
    return A.customer_stats(shipments(spark, sf))


@register(
    "a07_average",
    over_shipments("SELECT round(avg(weight_kg), 6)::DOUBLE AS average_weight, count(*)::BIGINT AS rows FROM ship"),
)
def a07(spark, sf):
    return A.average_of(shipments(spark, sf), "weight_kg", "average_weight", "rows")


@register(
    "a08_text_min_max",
    over_shipments(
        """SELECT shipper_phone, min(shipment_creation_date) AS first_text, max(shipment_creation_date) AS last_text
        FROM ship GROUP BY 1"""
    ),
)
def a08(spark, sf):
    dated = "shipment_creation_date"
    return (
        shipments(spark, sf)
        .groupBy("shipper_phone")
        .agg(F.min(dated).alias("first_text"), F.max(dated).alias("last_text"))
    )


@register(
    "a09_percent_of_total",
    over_shipments(
        """SELECT consignee_city, count(*)::BIGINT AS shipment_count,
        round(count(*) * 100.0 / (SELECT count(*) FROM ship), 2)::DOUBLE AS "Percentage" FROM ship GROUP BY 1"""
    ),
)
def a09(spark, sf):
    rows = shipments(spark, sf)
    return A.with_share(A.count_by(rows, "consignee_city"), A.grand_total(rows), "shipment_count")


@register(
    "a10_completeness",
    over_shipments(
        """SELECT count(consignee_city)::BIGINT AS total_with_value,
        count(*) FILTER (WHERE consignee_city <> '')::BIGINT AS non_empty FROM ship"""
    ),
)
def a10(spark, sf):
    return A.completeness(shipments(spark, sf), "consignee_city")


@register(
    "a11_next_position",
    over_tables(
        "dashboard_widgets", "SELECT (coalesce(max(position), -1) + 1)::INT AS next_position FROM dashboard_widgets"
    ),
)
def a11(spark, sf):
    return A.next_position(sample.dashboard_widgets(spark, sf))


@register("o01_newest_ids", over_shipments("SELECT id, number_shipment FROM ship ORDER BY id DESC LIMIT 500"))
def o01(spark, sf):
    return paging.newest_first(shipments(spark, sf)).limit(500).select("id", "number_shipment")


@register(
    "o02_newest_dates",
    over_shipments(
        "SELECT id, creation_ymd FROM ship ORDER BY creation_ymd DESC NULLS FIRST, id DESC LIMIT 500"
    ),
)
def o02(spark, sf):
    return paging.newest_first(shipments(spark, sf), paging.BY_DATE).limit(500).select("id", "creation_ymd")


@register(
    "o03_most_first",
    over_shipments(
        """SELECT consignee_name, count(*)::BIGINT AS shipment_count FROM ship GROUP BY 1
        ORDER BY shipment_count DESC, consignee_name LIMIT 100"""
    ),
)
def o03(spark, sf):
    return A.most_first(A.count_by(shipments(spark, sf), "consignee_name"), limit=100)


@register(
    "o04_by_label",
    over_shipments(
        """SELECT creation_ymd AS label, count(*)::BIGINT AS n FROM ship GROUP BY 1
        ORDER BY label DESC NULLS FIRST LIMIT 50"""
    ),
)
def o04(spark, sf):
    counts = A.count_by(shipments(spark, sf), F.col("creation_ymd").alias("label"), name="n")
    return counts.orderBy(F.desc_nulls_first("label")).limit(50)


@register(
    "o05_by_cast",
    over_shipments(
        """SELECT id, number_of_shipment_boxes FROM ship
        ORDER BY TRY_CAST(number_of_shipment_boxes AS INT) NULLS LAST, id LIMIT 300"""
    ),
)
def o05(spark, sf):
    boxes = P.boxes_int(F.col("number_of_shipment_boxes"))
    return (
        shipments(spark, sf)
        .orderBy(boxes.asc_nulls_last(), "id")
        .limit(300)
        .select("id", "number_of_shipment_boxes")
    )


@register(
    "o06_mixed_order",
    over_tables(
        "scheduled_reports",
        """SELECT id, next_run_at, created_at FROM scheduled_reports
        ORDER BY next_run_at ASC NULLS LAST, created_at DESC NULLS FIRST, id LIMIT 400""",
    ),
)
def o06(spark, sf):
    ordered = sample.scheduled_reports(spark, sf).orderBy(
        F.asc_nulls_last("next_run_at"), F.desc_nulls_first("created_at"), "id"
    )
    return ordered.limit(400).select("id", "next_run_at", "created_at")


@register(
    "o07_top_k",
    over_shipments(
        """SELECT id, weight_kg::DOUBLE AS weight_kg FROM ship ORDER BY weight_kg DESC NULLS LAST, id DESC LIMIT 100"""
    ),
)
def o07(spark, sf):
    top = shipments(spark, sf).orderBy(F.desc_nulls_last("weight_kg"), F.desc("id")).limit(100)
    return top.select("id", F.col("weight_kg").cast("double").alias("weight_kg"))


@register("o08_page", over_shipments("SELECT id, creation_ymd FROM ship ORDER BY id DESC LIMIT 50 OFFSET 100"))
def o08(spark, sf):
    return paging.page_rows(shipments(spark, sf), page=3, limit=50).select("id", "creation_ymd")


@register(
    "o08_deep_page",
    over_shipments(
        "SELECT id, creation_ymd FROM ship ORDER BY creation_ymd DESC NULLS FIRST, id DESC LIMIT 50 OFFSET 10000"
    ),
)
def o08_deep(spark, sf):
    """What is before the page is taken from the counts stored beside the shipments."""
    counts = sample.shipment_counts(spark, sf)
    rows = paging.page_rows(shipments(spark, sf), page=201, limit=50, order=paging.BY_DATE, counts=counts)
    return rows.select("id", "creation_ymd")


@register(
    "o08_deep_page_by_id",
    over_shipments("SELECT id, creation_ymd FROM ship ORDER BY id DESC LIMIT 50 OFFSET 12000"),
)
def o08_deep_id(spark, sf):
    return paging.page_rows(shipments(spark, sf), page=241, limit=50).select("id", "creation_ymd")


@register(
    "o08_deep_page_of_filter",
    over_shipments(
        """SELECT id, creation_ymd FROM ship WHERE weight_kg > 0.4
        ORDER BY creation_ymd DESC NULLS FIRST, id DESC LIMIT 30 OFFSET 300"""
    ),
)
def o08_deep_filter(spark, sf):
    """A filter has no stored counts: its rows are counted in the plan that reads them."""
    rows = paging.page_rows(shipments(spark, sf).where("weight_kg > 0.4"), page=11, limit=30, order=paging.BY_DATE)
    return rows.select("id", "creation_ymd")


@register(
    "o08_repeated_ids",
    over_shipments(
        """SELECT day, id, count(*)::BIGINT AS rows FROM (SELECT creation_ymd AS day, id // 10 AS id FROM ship
        ORDER BY 1 DESC NULLS FIRST, 2 DESC LIMIT 101 OFFSET 202) GROUP BY 1, 2"""
    ),
)
def o08_repeated(spark, sf):
    """A page over ids that repeat holds as many rows of each as it should."""
    rows = shipments(spark, sf).withColumn("id", F.expr("id div 10"))
    page = paging.page_rows(rows, page=3, limit=101, order=paging.BY_DATE)
    return page.groupBy(F.col("creation_ymd").alias("day"), "id").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "o08_after_key",
    over_shipments(
        """SELECT id, creation_ymd FROM ship WHERE creation_ymd < '20250615' OR (creation_ymd = '20250615' AND id < 900)
        ORDER BY creation_ymd DESC, id DESC LIMIT 40"""
    ),
)
def o08_after(spark, sf):
    """The rows that follow a date and id, as when a reader turns the page."""
    return paging.rows_after(shipments(spark, sf), 900, "20250615", 40, paging.BY_DATE).select("id", "creation_ymd")


@register(
    "o08_page_info",
    over_shipments(
        """SELECT 3::BIGINT AS page, 50::BIGINT AS "limit", count(*)::BIGINT AS total,
        ceil(count(*) / 50.0)::BIGINT AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next, true AS has_prev FROM ship"""
    ),
)
def o08_info(spark, sf):
    return paging.page_info(shipments(spark, sf), page=3, limit=50)


@register(
    "o09_sample_groups",
    over_shipments(
        'SELECT shipper_name, count(*)::BIGINT AS "count" FROM ship GROUP BY 1 ORDER BY shipper_name NULLS LAST LIMIT 5'
    ),
)
def o09(spark, sf):
    return A.sample_groups(shipments(spark, sf), "shipper_name")
