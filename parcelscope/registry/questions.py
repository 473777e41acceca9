"""Listings, analytics, search and predefined reports (S, G, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import search, segments
from ..operators.substrings import where_contains
from ..plans import analytics as G
from ..plans import listings as S
from ..plans import partials as P
from ..plans import reports as T
from ..plans import stored
from ..sources import write_once
from ..sources.sample import shipment_grams, shipment_partials, shipments
from .base import AS_OF, ORACLES, register
from .blocks import IN_MONTH, MANY, MANY_SQL
from .columns import PHONE_TYPE, REFERENCE_TYPE, WEIGHT_BAND, WEIGHT_BAND_KG
from .oracle import SHIPMENT_COLUMNS, month_case, over_shipments

IN_WEEK = "creation_ymd >= '20250725' AND creation_ymd <= '20250801'"
IN_YEAR = "creation_ymd >= '20240801' AND creation_ymd <= '20250801'"
BY_DATE = "creation_ymd DESC NULLS FIRST, id DESC"


def _rows(where: str, order: str, limit: int, offset: int = 0) -> str:
    return over_shipments(
        f"SELECT {SHIPMENT_COLUMNS} FROM ship WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    )


def _info(where: str, page: int, limit: int) -> str:
    pages = f"ceil(count(*) / {limit}.0)"
    return over_shipments(
        f"""SELECT {page}::BIGINT AS page, {limit}::BIGINT AS "limit", count(*)::BIGINT AS total,
        {pages}::BIGINT AS total_pages, {page} < {pages} AS has_next, {page} > 1 AS has_prev FROM ship WHERE {where}"""
    )


def _paged(key: str, where: str, order: str, page: int, limit: int, run) -> None:
    """Registers the rows and the facts of a paged listing."""
    register(key, _rows(where, order, limit, (page - 1) * limit))(lambda spark, sf: run(shipments(spark, sf)).rows)
    register(f"{key}_page_info", _info(where, page, limit))(lambda spark, sf: run(shipments(spark, sf)).info)


_paged("list_shipments", "true", "id DESC", 1, 10, S.list_shipments)
_paged(
    "list_shipments_of_year",
    IN_YEAR,
    "id DESC",
    4,
    25,
    lambda df: S.list_shipments(df, page=4, limit=25, date_filter="year", as_of=AS_OF),
)
_paged(
    "list_shipments_custom_range",
    "creation_ymd >= '20240105' AND creation_ymd <= '20240210'",
    "id DESC",
    2,
    10,
    lambda df: S.list_shipments(df, page=2, date_filter="week", start="2024-01-05", end="2024-02-10"),
)
_paged(
    "filter_shipments",
    f"shipper_city LIKE '%NATION_1%' AND {IN_YEAR}",
    BY_DATE,
    2,
    20,
    lambda df: S.filter_shipments(df, "shipper_city", "NATION_1", "year", page=2, as_of=AS_OF),
)
_paged(
    "advanced_search",
    MANY_SQL,
    BY_DATE,
    1,
    20,
    lambda df: S.advanced_search(df, **MANY),
)
_paged(
    "advanced_search_cities",
    "shipper_city LIKE '%NATION_2%' AND consignee_city LIKE '%NATION_3%'",
    BY_DATE,
    1,
    5,
    lambda df: S.advanced_search(df, limit=5, from_city="NATION_2", to_city="NATION_3"),
)


@register(
    "recent_shipments",
    _rows("shipment_creation_date IS NOT NULL AND shipment_creation_date <> ''", "id DESC", 20),
)
def recent(spark, sf):
    return S.recent_shipments(shipments(spark, sf))


@register(
    "recent_shipments_today",
    _rows(
        "creation_ymd = '20250801' AND shipment_creation_date <> ''",
        "id DESC",
        2000,
    ),
)
def recent_today(spark, sf):
    return S.recent_shipments(shipments(spark, sf), limit=2000, date_filter="today", as_of=AS_OF)


@register("by_weight", _rows("weight_kg > 0", BY_DATE, 50))
def by_weight(spark, sf):
    return S.by_weight(shipments(spark, sf))


@register("by_weight_of_month", _rows(f"weight_kg > 1 AND {IN_MONTH}", BY_DATE, 50))
def by_weight_of_month(spark, sf):
    return S.by_weight(shipments(spark, sf), 1.0, "month", as_of=AS_OF)


@register("by_shipper", _rows(f"shipper_name LIKE '%00001%' AND {IN_YEAR}", BY_DATE, 50))
def by_shipper(spark, sf):
    return S.by_shipper(shipments(spark, sf), "00001", "year", as_of=AS_OF)


@register("by_consignee", _rows("consignee_name LIKE '%#00000007%'", BY_DATE, 50))
def by_consignee(spark, sf):
    return S.by_consignee(shipments(spark, sf), "#00000007")


def _padded(text: str) -> str:
    """DuckDB text of the words, each between single blanks."""
    split = rf"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')"
    return f"' ' || array_to_string(list_filter({split}, lambda w: w <> ''), ' ') || ' '"


_SEARCH_TEXT = "concat_ws(' ', " + ", ".join(search.SEARCH_COLUMNS) + ")"
_SEARCHED = f"(SELECT *, {_padded(_SEARCH_TEXT)} AS words FROM ship) ship"

_QUERY = 'nation_3 "4 not specified" or "supplier 000000007" -nation_2'
_QUERY_SQL = """((contains(words, ' nation 3 ') AND contains(words, ' 4 not specified '))
    OR (contains(words, ' supplier 000000007 ') AND NOT contains(words, ' nation 2 ')))"""


def _searched(key: str, where: str, page: int, limit: int, run) -> None:
    for name, rows, sql in (
        (key, True, _rows(where, BY_DATE, limit, (page - 1) * limit)),
        (f"{key}_page_info", False, _info(where, page, limit)),
    ):
        register(name, sql.replace("FROM ship WHERE", f"FROM {_SEARCHED} WHERE"))(
            lambda spark, sf, rows=rows: run(spark, sf)[0 if rows else 1]
        )


_searched(
    "search_shipments",
    f"{_QUERY_SQL} AND creation_ymd >= '20240801' AND creation_ymd <= '20250801'",
    1,
    20,
    lambda spark, sf: S.search_shipments(shipments(spark, sf), _QUERY, "year", as_of=AS_OF),
)


def _shipments_index(spark, sf):
    inputs = [f"{sf}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    return _index(spark, "shipments_index", inputs, shipments(spark, sf), search.SEARCH_COLUMNS, "id")


def _documents_index(spark, sf):
    return _index(spark, "documents_index", [f"{sf}/documents.parquet"], _documents(spark, sf), ("text",), "doc_id")


def _index(spark, name: str, inputs: list[str], rows, columns: tuple[str, ...], key: str):
    """Stored postings."""
    path = write_once(spark, name, inputs, lambda to, tasks: search.store_index(rows, to, tasks, *columns, key=key))
    return spark.read.schema(f"token string, {key} long, pos int, bucket int").parquet(path)


_searched(
    "search_shipments_index",
    _QUERY_SQL,
    2,
    20,
    lambda spark, sf: S.search_shipments(
        shipments(spark, sf), _QUERY, page=2, index=_shipments_index(spark, sf)
    ),
)

_GROWN_QUERY = 'moved nation_3 or "9 moved" or nation_4 -"4 not specified"'
_GROWN = """(SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'moved ' || (id % 11)::VARCHAR ELSE consignee_city END AS consignee_city)
    FROM ship WHERE id % 7 <> 0) ship"""
_GROWN_SQL = f"""SELECT id FROM (SELECT *, {_padded(_SEARCH_TEXT)} AS words FROM {_GROWN})
    WHERE (contains(words, ' moved ') AND contains(words, ' nation 3 ')) OR contains(words, ' 9 moved ')
    OR (contains(words, ' nation 4 ') AND NOT contains(words, ' 4 not specified '))"""


def _grown_index(spark, sf) -> str:
    """An index written in three batches: even ids, odd ids, and changes to both."""
    rows = shipments(spark, sf)

    def write(to: str, tasks: int) -> None:
        segments.add_segment(rows.where("id % 2 = 0"), to, 1, tasks=tasks)
        segments.add_segment(rows.where("id % 2 = 1"), to, 2, tasks=tasks)
        changed = rows.where("id % 5 = 0 AND id % 7 <> 0")
        city = F.expr("'moved ' || CAST(id % 11 AS STRING)")
        gone = rows.where("id % 5 = 0 OR id % 7 = 0")
        segments.add_segment(changed.withColumn("consignee_city", city), to, 3, tasks=tasks, removed=gone)

    inputs = [f"{sf}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    return write_once(spark, "growing_index", inputs, write)


@register("s08_growing_index", over_shipments(_GROWN_SQL))
def growing_index(spark, sf):
    """A search over the segments of three batches, one of which replaces and removes rows."""
    return search.search_index(segments.open_segments(spark, _grown_index(spark, sf)), _GROWN_QUERY)


@register("s08_folded_index", over_shipments(_GROWN_SQL))
def folded_index(spark, sf):
    """The same search after the three segments were folded into one."""
    path = _grown_index(spark, sf)
    folded = write_once(
        spark, "folded_index", [path], lambda to, tasks: segments.fold_segments(spark, path, to, 3, tasks)
    )
    return search.search_index(segments.open_segments(spark, folded), _GROWN_QUERY)


_DOC_QUERY = "the -and or \"in the\""
_DOC_SQL = "(contains(words, ' the ') AND NOT contains(words, ' and ')) OR contains(words, ' in the ')"
_DOCS = f"(SELECT *, {_padded('text')} AS words FROM documents)"


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@register("search_documents", f"SELECT doc_id, lang FROM {_DOCS} WHERE {_DOC_SQL}")
def search_documents(spark, sf):
    documents = _documents(spark, sf)
    return documents.where(search.matches_search(F.col("text"), _DOC_QUERY)).select("doc_id", "lang")


@register("search_documents_index", f"SELECT doc_id FROM {_DOCS} WHERE {_DOC_SQL}")
def search_documents_index(spark, sf):
    return search.search_index(_documents_index(spark, sf), _DOC_QUERY, key="doc_id")


@register("search_documents_excluded", f"SELECT doc_id FROM {_DOCS} WHERE NOT contains(words, ' the ')")
def search_documents_excluded(spark, sf):
    """Only excluded words: the index cannot name the documents, so the table of all documents joins in."""
    index = _documents_index(spark, sf)
    return search.search_index(index, "-the", universe=_documents(spark, sf), key="doc_id")


@register(
    "s08_index_postings",
    rf"""SELECT token, count(*)::BIGINT AS postings, count(DISTINCT doc_id)::BIGINT AS documents FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS token FROM documents)
    WHERE token <> '' GROUP BY token""",
)
def index_postings(spark, sf):
    per_document = _documents_index(spark, sf).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("token").agg(
        F.sum("n").alias("postings"), F.count(F.lit(1)).alias("documents")
    )


@register(
    "s08_tokens",
    rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))::INT
    AS words FROM documents""",
)
def token_counts(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size(tokens(F.col("text"))).alias("words"))


_NAMED = "shipper_name IS NOT NULL AND shipper_name <> ''"
_CITY = "consignee_city IS NOT NULL AND consignee_city <> '' AND consignee_city <> 'NULL'"
_DIGIT = "regexp_matches(shipment_weight, '[0-9]')"


def _customers(source: str, where: str = "true") -> str:
    return over_shipments(
        f"""SELECT shipper_name, min(shipper_phone) AS shipper_phone, count(*)::BIGINT AS shipment_count,
        count(DISTINCT consignee_name)::BIGINT AS unique_consignees FROM {source} WHERE {where} GROUP BY shipper_name
        ORDER BY shipment_count DESC, shipper_name, shipper_phone NULLS LAST, unique_consignees LIMIT 10"""
    )


def _cities(source: str, where: str, limit: int) -> str:
    return over_shipments(
        f"""SELECT consignee_city AS city, count(*)::BIGINT AS shipment_count FROM {source} WHERE {where}
        GROUP BY consignee_city ORDER BY shipment_count DESC, city NULLS LAST LIMIT {limit}"""
    )


def _weight(source: str, where: str = "true") -> str:
    return over_shipments(
        f"""SELECT round(avg(weight_kg), 6)::DOUBLE AS average_weight, count(*)::BIGINT AS total_shipments
        FROM {source} WHERE {where}"""
    )


@register("top_customers", _customers("ship", _NAMED))
def top_customers(spark, sf):
    return G.top_customers(shipments(spark, sf))


@register("top_customers_by_date", _customers("ship", f"{_NAMED} AND {IN_YEAR}"))
def top_customers_by_date(spark, sf):
    return G.top_customers(shipments(spark, sf), date_filter="year", as_of=AS_OF)


@register("by_city", _cities("ship", IN_MONTH, 20))
def by_city(spark, sf):
    return G.by_city(shipments(spark, sf), as_of=AS_OF)


@register("by_city_total", _cities("ship", "true", 30))
def by_city_total(spark, sf):
    return G.by_city(shipments(spark, sf), "total", limit=30)


@register("average_weight", _weight("ship", _DIGIT))
def average_weight(spark, sf):
    return G.average_weight(shipments(spark, sf))


@register("average_weight_by_date", _weight("ship", f"{_DIGIT} AND {IN_MONTH}"))
def average_weight_by_date(spark, sf):
    return G.average_weight(shipments(spark, sf), "month", as_of=AS_OF)


def _total(source: str, where: str) -> str:
    return over_shipments(f"SELECT count(*)::BIGINT AS total FROM {source} WHERE {where}")


@register("total_shipments", _total("ship", IN_MONTH))
def total_shipments(spark, sf):
    return G.total_shipments(shipments(spark, sf), as_of=AS_OF)


@register("total_shipments_all", _total("ship", "true"))
def total_shipments_all(spark, sf):
    return G.total_shipments(shipments(spark, sf), "total")


@register("total_shipments_by_date", _total("ship", "creation_ymd >= '20240101' AND creation_ymd <= '20241231'"))
def total_shipments_by_date(spark, sf):
    return G.total_shipments(shipments(spark, sf), start="2024-01-01", end="2024-12-31")


@register("top_cities", _cities("ship", f"{_CITY} AND {IN_WEEK}", 10))
def top_cities(spark, sf):
    return G.top_cities(shipments(spark, sf), date_filter="week", as_of=AS_OF)


@register("top_cities_total", _cities("ship", _CITY, 10))
def top_cities_total(spark, sf):
    return G.top_cities(shipments(spark, sf), date_filter="total")


@register("top_cities_by_date", _cities("ship", f"{_CITY} AND {IN_MONTH}", 10))
def top_cities_by_date(spark, sf):
    return G.top_cities(shipments(spark, sf), as_of=AS_OF)


@register(
    "customer_sample",
    over_shipments(
        'SELECT shipper_name, count(*)::BIGINT AS "count" FROM ship GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 5'
    ),
)
def customer_sample(spark, sf):
    return G.customer_sample(shipments(spark, sf))


@register(
    "city_completeness",
    over_shipments(
        """SELECT (SELECT count(consignee_city) FROM ship)::BIGINT AS total_with_city,
        (SELECT count(*) FROM ship WHERE consignee_city <> '')::BIGINT AS non_empty_cities,
        consignee_city AS sample_city, count(*)::BIGINT AS sample_count FROM ship WHERE consignee_city <> ''
        GROUP BY consignee_city ORDER BY consignee_city LIMIT 5"""
    ),
)
def city_completeness(spark, sf):
    return G.city_completeness(shipments(spark, sf))


def _summary(total: str, weight: str, cities: str) -> str:
    return over_shipments(
        f"""SELECT (SELECT count(*) FROM ship WHERE {total})::BIGINT AS total_shipments,
        (SELECT round(avg(weight_kg), 6) FROM ship WHERE {weight})::DOUBLE AS average_weight,
        consignee_city AS city, count(*)::BIGINT AS shipment_count FROM ship WHERE {cities}
        GROUP BY consignee_city ORDER BY shipment_count DESC, city LIMIT 5"""
    )


@register(
    "analytics_summary",
    _summary(IN_MONTH, f"{_DIGIT} AND {IN_MONTH}", f"{_CITY} AND {IN_MONTH}"),
)
def analytics_summary(spark, sf):
    return G.analytics_summary_flat(shipments(spark, sf), as_of=AS_OF)


@register("analytics_summary_by_date", _summary(IN_YEAR, f"{_DIGIT} AND {IN_YEAR}", f"{_CITY} AND {IN_YEAR}"))
def analytics_summary_by_date(spark, sf):
    return G.analytics_summary_flat(shipments(spark, sf), date_filter="year", as_of=AS_OF)


_PHONE = "shipper_phone LIKE '%800%'"
_MON = r"nullif(regexp_extract(shipment_creation_date, '\d{2}-([A-Za-z]{3})-\d{2}', 1), '')"
_YY = r"nullif(regexp_extract(shipment_creation_date, '\d{2}-[A-Za-z]{3}-(\d{2})', 1), '')"


def _monthly(name: str, where: str) -> str:
    return over_shipments(
        f"""SELECT {month_case('mon')} || '-20' || yy AS "Month", n AS "{name}" FROM (
        SELECT {_MON} AS mon, {_YY} AS yy, count(*)::BIGINT AS n FROM ship WHERE {where} GROUP BY 1, 2)
        ORDER BY "Month" DESC NULLS FIRST, "{name}" DESC"""
    )


def _share(name: str, key: str, alias: str, where: str, of: str = "true", tail: str = "") -> str:
    return over_shipments(
        f"""SELECT {key} AS "{alias}", count(*)::BIGINT AS "{name}",
        round(count(*) * 100.0 / (SELECT count(*) FROM ship WHERE {of}), 2)::DOUBLE AS "Percentage"
        FROM ship WHERE {where} GROUP BY {key} {tail}"""
    )


def _report(key: str, sql: str, run, report_id: str | None = None, **params) -> None:
    """Registers a report as a function and, under its catalogue id, as stored SQL; both have one oracle."""
    register(key, sql)(lambda spark, sf: run(shipments(spark, sf), **params))
    if report_id is None:
        return
    text = T.BY_ID[report_id].sql_query
    register(f"stored_{report_id}", sql)(
        lambda spark, sf: stored.run_sql(spark, shipments(spark, sf), text, **params)
    )


_report(
    "monthly_by_phone",
    _monthly("Total Shipments", _PHONE),
    T.monthly_by_phone,
    "monthly_shipments_by_phone",
    phone_number="800",
)
_report(
    "monthly_sal",
    _monthly("SAL Shipments", "regexp_matches(shipment_reference_number, '^SAL[0-9]+$')"),
    T.monthly_sal,
    "shipments_by_sal_pattern",
)
_report(
    "top20_cities",
    _share(
        "Total Shipments",
        "consignee_city",
        "City",
        "consignee_city IS NOT NULL",
        tail="ORDER BY count(*) DESC, consignee_city LIMIT 20",
    ),
    T.top20_cities,
    "top_20_destination_cities",
)
_SHIPPERS = """SELECT shipper_phone AS "Phone", shipper_name AS "Name", count(*)::BIGINT AS "Recent Shipments"
    FROM ship WHERE {where} GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 15"""
_report(
    "top15_shippers",
    over_shipments(_SHIPPERS.format(where="shipment_creation_date >= '01-Oct-25'")),
    T.top15_shippers,
    "top_15_active_shippers",
)
_report(
    "top15_shippers_by_date", over_shipments(_SHIPPERS.format(where=IN_MONTH)), T.top15_shippers_by_date, as_of=AS_OF
)
_report(
    "weight_distribution",
    over_shipments(
        f"""SELECT {WEIGHT_BAND} AS "Weight Range", count(*)::BIGINT AS "Count" FROM ship
        WHERE shipment_weight IS NOT NULL GROUP BY 1"""
    ),
    T.weight_distribution,
    "shipment_distribution_by_weight",
)
_report(
    "weight_distribution_by_number",
    over_shipments(
        f"""SELECT {WEIGHT_BAND_KG} AS "Weight Range", count(*)::BIGINT AS "Count" FROM ship
        WHERE weight_kg IS NOT NULL GROUP BY 1"""
    ),
    T.weight_distribution_kg,
)
_report(
    "daily_volume",
    over_shipments(
        r"""SELECT shipment_creation_date AS "Date", count(*)::BIGINT AS "Shipments" FROM ship
        WHERE regexp_matches(shipment_creation_date, '\d{2}-[A-Za-z]{3}-25$') GROUP BY 1 ORDER BY 1 DESC LIMIT 30"""
    ),
    T.daily_volume,
    "daily_shipment_volume",
)
_report(
    "daily_volume_by_date",
    over_shipments(
        f"""SELECT creation_ymd AS "Date", count(*)::BIGINT AS "Shipments" FROM ship WHERE {IN_MONTH} GROUP BY 1
        ORDER BY 1 DESC"""
    ),
    T.daily_volume_by_date,
    as_of=AS_OF,
)
_report(
    "shipper_cities_served",
    over_shipments(
        f"""SELECT shipper_phone AS "Phone", shipper_name AS "Name", count(*)::BIGINT AS "Total Shipments",
        count(DISTINCT consignee_city)::BIGINT AS "Cities Served" FROM ship WHERE {_PHONE} GROUP BY 1, 2"""
    ),
    T.shipper_cities_served,
    "shipper_performance_cities",
    phone_number="800",
)
_report(
    "phone_patterns",
    _share("Count", PHONE_TYPE, "Phone Type", "true"),
    T.phone_patterns,
    "phone_number_pattern_analysis",
)
_report(
    "city_routes",
    over_shipments(
        """SELECT shipper_city AS "Origin", consignee_city AS "Destination", count(*)::BIGINT AS "Shipments" FROM ship
        WHERE shipper_city IS NOT NULL AND consignee_city IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"""
    ),
    T.city_routes,
    "city_to_city_routes",
)
_report(
    "reference_types",
    _share("Count", REFERENCE_TYPE, "Pattern Type", "true"),
    T.reference_types,
    "reference_number_type_distribution",
)
_report(
    "shipper_top_cities",
    _share(
        "Shipments",
        "consignee_city",
        "City",
        f"{_PHONE} AND consignee_city IS NOT NULL",
        of=_PHONE,
        tail="ORDER BY count(*) DESC, consignee_city LIMIT 10",
    ),
    T.shipper_top_cities,
    "specific_shipper_top_cities",
    phone_number="800",
)
_report(
    "multi_box",
    _share("Shipments", "number_of_shipment_boxes", "Boxes", "number_of_shipment_boxes IS NOT NULL"),
    T.multi_box,
    "multi_box_shipments_analysis",
)
_report(
    "top_shippers",
    over_shipments(
        """SELECT shipper_phone AS "Phone", shipper_name AS "Name", shipper_city AS "City",
        count(*)::BIGINT AS "Total Shipments" FROM ship GROUP BY 1, 2, 3
        ORDER BY 4 DESC, 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST LIMIT 25"""
    ),
    T.top_shippers,
    "top_shippers_by_total_shipments",
)
_report(
    "shippers_to_city",
    over_shipments(
        """SELECT shipper_name AS "Shipper", shipper_phone AS "Phone", count(*)::BIGINT AS "Shipments to NATION_3"
        FROM ship WHERE consignee_city = 'NATION_3' GROUP BY 1, 2
        ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 20"""
    ),
    T.shippers_to_city,
    "shipments_by_specific_city",
    city_name="NATION_3",
)


def _shipper_summary(first: str, last: str) -> str:
    return over_shipments(
        f"""SELECT shipper_phone AS "Phone", shipper_name AS "Name", count(*)::BIGINT AS "Total Shipments",
        count(DISTINCT consignee_city)::BIGINT AS "Cities", {first} AS "First Ship", {last} AS "Last Ship"
        FROM ship WHERE {_PHONE} GROUP BY 1, 2"""
    )


_report(
    "shipper_summary",
    _shipper_summary("min(shipment_creation_date)", "max(shipment_creation_date)"),
    T.shipper_summary,
    "comprehensive_shipper_summary",
    phone_number="800",
)
_DAY = (
    "strftime({end}(CASE WHEN regexp_matches(creation_ymd, '^[0-9]{{8}}$') THEN "
    "strptime(creation_ymd, '%Y%m%d') END), '%Y-%m-%d')"
)
_report(
    "shipper_summary_by_date",
    _shipper_summary(_DAY.format(end="min"), _DAY.format(end="max")),
    T.shipper_summary_by_date,
    phone_number="800",
)


def _partials(key: str, sql: str, run) -> None:
    """A question answered from monthly partials, against the text of the same question over rows."""
    register(key, sql)(lambda spark, sf: run(shipment_partials(spark, sf)))


_partials("by_city_partials", _cities("ship", IN_YEAR, 20), lambda parts: P.by_city(parts, "year", as_of=AS_OF))
_partials("top_cities_partials", _cities("ship", f"{_CITY} AND {IN_MONTH}", 10), lambda parts: P.top_cities(parts, as_of=AS_OF))
_partials("top_cities_partials_total", _cities("ship", _CITY, 10), lambda parts: P.top_cities(parts, date_filter="total"))
_partials(
    "total_shipments_partials",
    over_shipments(f"SELECT count(*)::BIGINT AS total FROM ship WHERE {IN_YEAR}"),
    lambda parts: P.total_shipments(parts, "year", as_of=AS_OF),
)
_partials(
    "average_weight_partials", _weight("ship", f"{_DIGIT} AND {IN_YEAR}"), lambda parts: P.average_weight(parts, "year", as_of=AS_OF)
)
_partials(
    "top_customers_partials",
    _customers("ship", f"{_NAMED} AND {IN_YEAR}"),
    lambda parts: P.top_customers(parts, date_filter="year", as_of=AS_OF),
)
_partials("top20_cities_partials", ORACLES["top20_cities"], P.top20_cities)
_partials("city_routes_partials", ORACLES["city_routes"], P.city_routes)


@register("top_customers_approximate", _customers("ship", f"{_NAMED} AND {IN_YEAR}"))
def top_customers_approximate(spark, sf):
    """Distinct consignees from merged sketches, which are exact while a shipper has few of them."""
    return P.top_customers(shipment_partials(spark, sf), date_filter="year", as_of=AS_OF, approximate=True)


@register("by_shipper_index", ORACLES["by_shipper"])
def by_shipper_index(spark, sf):
    return S.by_shipper(shipments(spark, sf), "00001", "year", as_of=AS_OF, grams=shipment_grams(spark, sf))


@register("by_consignee_index", ORACLES["by_consignee"])
def by_consignee_index(spark, sf):
    return S.by_consignee(shipments(spark, sf), "#00000007", grams=shipment_grams(spark, sf))


@register("filter_index", _rows("shipment_reference_number LIKE '%SAL%48%'", BY_DATE, 20, 20))
def filter_index(spark, sf):
    """A pattern with a wildcard: its plain part finds the rows to look at."""
    grams = shipment_grams(spark, sf)
    return S.filter_shipments(shipments(spark, sf), "shipment_reference_number", "SAL%48", page=2, grams=grams).rows


@register("filter_index_scan", _rows("shipper_phone LIKE '%_2%'", BY_DATE, 20))
def filter_index_scan(spark, sf):
    """A pattern too short for the index scans."""
    return S.filter_shipments(shipments(spark, sf), "shipper_phone", "_2", grams=shipment_grams(spark, sf)).rows


@register("monthly_by_phone_index", ORACLES["monthly_by_phone"])
def monthly_by_phone_index(spark, sf):
    """The report over the rows that the index finds."""
    rows = where_contains(shipments(spark, sf), "shipper_phone", "800", shipment_grams(spark, sf))
    return T.monthly_by_phone(rows, "800")
