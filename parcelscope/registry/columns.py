"""Scans, sinks and column functions (R, N, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as N
from ..operators.changes import new_rows
from ..operators.paging import first_rows
from ..sources import (
    ensure_tables,
    export_csv,
    export_csv_parts,
    export_summary,
    from_json_rows,
    from_rows,
    load_table,
    publish,
    sample,
    scratch_path,
)
from ..sources.rows import json_keys
from ..sources.sample import shipments
from ..schema import SHIPMENT_COLUMNS, TABLES
from . import oracle
from .base import register
from .oracle import over_shipments, over_tables

_ALL = oracle.SHIPMENT_COLUMNS


@register("r01_scan", over_shipments(f"SELECT {_ALL} FROM ship"))
def r01(spark, sf):
    return shipments(spark, sf).select(*SHIPMENT_COLUMNS)


_RECORD = ("number_shipment", "shipper_name", "consignee_city", "cod")


@register("r03_inline_rows", over_shipments(f"SELECT id, {', '.join(_RECORD)} FROM ship"))
def r03(spark, sf):
    # to_json leaves NULL keys out, so the records have differing keys.
    records = shipments(spark, sf).select("id", F.to_json(F.struct(*_RECORD)).alias("record"))
    return from_json_rows(records, "record", list(_RECORD), keep=("id",))


@register(
    "r03_record_keys",
    over_shipments(
        " UNION ALL ".join(
            f"SELECT '{name}' AS key, count({name})::BIGINT AS records FROM ship" for name in _RECORD
        )
    ),
)
def r03_keys(spark, sf):
    return json_keys(shipments(spark, sf).select(F.to_json(F.struct(*_RECORD)).alias("record")), "record")


_EXPORTED = [name for name in SHIPMENT_COLUMNS if name not in ("id", "created_at")]


@register(
    "export_csv",
    over_shipments(
        "SELECT id::VARCHAR AS id, " + ", ".join(f"nullif({name}, '') AS {name}" for name in _EXPORTED) + " FROM ship"
    ),
)
def x01(spark, sf):
    """Written and read back."""
    path = scratch_path(spark, "export")
    export_csv(shipments(spark, sf).select("id", *_EXPORTED), path)
    read = spark.read.option("header", True).option("escape", '"').schema(
        ", ".join(f"{name} string" for name in ("id", *_EXPORTED))
    )
    return read.csv(path)


def _read_joined(spark, path: str, columns: list[str]):
    """The parts put one after the other in the order of their names, read as one file."""
    parts = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("name"))
    joined = parts.agg(F.array_join(F.array_sort(F.collect_list(F.struct("name", "value")))["value"], "").alias("text"))
    joined = joined.select(F.rtrim("text", F.lit("\n")))  # the writer ends the file with a line break itself
    folder = scratch_path(spark, "joined")
    joined.write.text(folder)
    schema = ", ".join(f"{name} string" for name in columns)
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(folder)


_INLINE = ["id", "number_shipment", "shipper_name", "consignee_city", "cod"]


@register(
    "x01_inline_rows_to_csv",
    over_shipments(
        f"""SELECT id::VARCHAR AS id, {', '.join(f"nullif({name}, '') AS {name}" for name in _INLINE[1:])}
        FROM ship ORDER BY ship.id DESC LIMIT 500"""
    ),
)
def x01_inline(spark, sf):
    """A caller's records, with keys left out where they have no value, become one CSV file out of many parts."""
    newest = first_rows(shipments(spark, sf), 500).select(*_INLINE).collect()  # what a caller sends along
    rows = [{key: value for key, value in row.asDict().items() if value is not None} for row in newest]
    path = scratch_path(spark, "inline")
    export_csv_parts(from_rows(spark, rows).select(*_INLINE), path)
    return _read_joined(spark, path, _INLINE)


@register(
    "x01_ordered_parts",
    over_shipments(
        "SELECT id::VARCHAR AS id, " + ", ".join(f"nullif({name}, '') AS {name}" for name in _EXPORTED) + " FROM ship"
    ),
)
def x01_parts(spark, sf):
    """All shipments as parts in the order of their ids with one header, read back part by part."""
    path = scratch_path(spark, "ordered")
    columns = ["id", *_EXPORTED]
    export_csv_parts(shipments(spark, sf).select(*columns), path)
    # no value holds a line break, so the parts can be read apart; the header is a row of its own then
    read = spark.read.schema(", ".join(f"{name} string" for name in columns)).option("escape", '"').csv(path)
    return read.where("id <> 'id'")


@register("r05_export_summary", over_shipments("SELECT 'csv' AS format, count(*)::BIGINT AS records FROM ship"))
def r05(spark, sf):
    return export_summary(shipments(spark, sf).select(*_EXPORTED), scratch_path(spark, "summary"))


_SMALL = ("saved_searches", "custom_reports", "scheduled_reports", "dashboard_widgets")


@register(
    "r06_small_tables",
    over_tables(
        " ".join(_SMALL),
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*)::BIGINT AS rows, max(id)::BIGINT AS last_id FROM {name}"
            for name in _SMALL
        ),
    ),
)
def r06(spark, sf):
    """Created in the catalog, published as a new version and scanned."""
    path = scratch_path(spark, "tables")
    database = f"small_{path[-12:]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}/db'")
    ensure_tables(spark, path, database)
    parts = []
    for name in _SMALL:
        publish(getattr(sample, name)(spark, sf), name, path, database)
        rows = load_table(spark, name, database)
        parts.append(
            rows.agg(
                F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id")
            )
        )
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    # The few result rows are written, so that the database can go again.
    first.write.parquet(f"{path}/result")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.read.parquet(f"{path}/result")


@register(
    "r07_defaults",
    over_tables(
        "changes schedule_changes scheduled_reports",
        """SELECT (SELECT max(id) FROM scheduled_reports) + row_number() OVER (ORDER BY seq) AS id, report_id,
        schedule_name, coalesce(schedule_type, 'daily') AS schedule_type,
        coalesce(schedule_time, '09:00:00') AS schedule_time, '[]' AS schedule_days, '[]' AS email_recipients,
        coalesce(email_subject, '') AS email_subject, '' AS email_body, true AS is_active, changed_at AS created_at,
        changed_at AS updated_at, 'default_user' AS user_id
        FROM schedule_changes WHERE op = 'insert'""",
    ),
)
def r07(spark, sf):
    base = sample.scheduled_reports(spark, sf)
    rows = new_rows(base, sample.schedule_changes(spark, sf).drop("is_active"), "scheduled_reports")
    return rows.drop("next_run_at", "last_run_at")


@register(
    "n01_creation_ymd",
    over_shipments(f"SELECT id, {oracle.ymd('shipment_creation_date')} AS creation_ymd FROM raw"),
)
def n01(spark, sf):
    return shipments(spark, sf).select(
        "id", N.creation_ymd(F.col("shipment_creation_date")).alias("creation_ymd")
    )


@register(
    "n02_creation_ymd_strict",
    over_shipments(
        f"""SELECT id, CASE WHEN length(shipment_creation_date) = 9 THEN '20' || substr(shipment_creation_date, 8, 2)
        || {oracle.month_case("substr(shipment_creation_date, 4, 3)")} || substr(shipment_creation_date, 1, 2) END
        AS creation_ymd FROM raw"""
    ),
)
def n02(spark, sf):
    return shipments(spark, sf).select(
        "id", N.creation_ymd(F.col("shipment_creation_date"), strict=True).alias("creation_ymd")
    )


@register(
    "n03_iso_to_ymd", over_shipments("SELECT id, replace(processing_date, '-', '') AS processing_ymd FROM ship")
)
def n03(spark, sf):
    return shipments(spark, sf).select("id", N.iso_to_ymd(F.col("processing_date")).alias("processing_ymd"))


@register(
    "n04_weight_kg",
    over_shipments("SELECT id, shipment_weight, weight_kg::DOUBLE AS weight_kg FROM ship"),
)
def n04(spark, sf):
    weight = N.parse_amount(F.col("shipment_weight")).cast("double")
    return shipments(spark, sf).select("id", "shipment_weight", weight.alias("weight_kg"))


@register("n05_cod_amount", over_shipments("SELECT id, cod, cod_amount::DOUBLE AS cod_amount FROM ship"))
def n05(spark, sf):
    return shipments(spark, sf).select("id", "cod", N.parse_amount(F.col("cod")).cast("double").alias("cod_amount"))


@register(
    "n06_has_digit",
    over_shipments("SELECT id, coalesce(regexp_matches(shipment_weight, '[0-9]'), false) AS has_digit FROM ship"),
)
def n06(spark, sf):
    found = F.coalesce(N.has_digit(F.col("shipment_weight")), F.lit(False))
    return shipments(spark, sf).select("id", found.alias("has_digit"))


@register(
    "n07_is_dmy",
    over_shipments("SELECT id, coalesce(shipment_creation_date LIKE '__-___-__', false) AS is_dmy FROM ship"),
)
def n07(spark, sf):
    found = F.coalesce(N.is_dmy(F.col("shipment_creation_date")), F.lit(False))
    return shipments(spark, sf).select("id", found.alias("is_dmy"))


_MON = r"nullif(regexp_extract(shipment_creation_date, '\d{2}-([A-Za-z]{3})-\d{2}', 1), '')"
_YY = r"nullif(regexp_extract(shipment_creation_date, '\d{2}-[A-Za-z]{3}-(\d{2})', 1), '')"


@register("n08_month_and_year", over_shipments(f"SELECT id, {_MON} AS mon, {_YY} AS yy FROM ship"))
def n08(spark, sf):
    dated = F.col("shipment_creation_date")
    return shipments(spark, sf).select("id", N.dmy_month(dated).alias("mon"), N.dmy_year(dated).alias("yy"))


@register(
    "n09_month_label",
    over_shipments(f"SELECT id, {oracle.month_case(_MON)} || '-20' || {_YY} AS month_label FROM ship"),
)
def n09(spark, sf):
    return shipments(spark, sf).select("id", N.month_label(F.col("shipment_creation_date")).alias("month_label"))


# The class labels, patterns and weight bands of the reports, in DuckDB's words.
PHONE_TYPE = """CASE WHEN regexp_matches(shipper_phone, '^05[0-9]{8}$') THEN 'Saudi Mobile (05)'
    WHEN regexp_matches(shipper_phone, '^9[0-9]{8,10}$') THEN 'Business (9xx)'
    WHEN regexp_matches(shipper_phone, '^8[0-9]{9}$') THEN 'Toll-Free (800x)' ELSE 'Other' END"""

REFERENCE_TYPE = """CASE WHEN regexp_matches(shipment_reference_number, '^SAL[0-9]+$') THEN 'SAL Pattern'
    WHEN regexp_matches(shipment_reference_number, '^[0-9]+$') THEN 'Numbers Only'
    WHEN regexp_matches(shipment_reference_number, '^[0-9]+-[0-9]+$') THEN 'Numbers with Dash' ELSE 'Other' END"""

WEIGHT_BAND = """CASE WHEN shipment_weight = '0.10 Kg' THEN '0-0.10 Kg'
    WHEN shipment_weight IN ('0.20 Kg', '0.30 Kg', '0.50 Kg') THEN '0.11-0.50 Kg'
    WHEN shipment_weight IN ('1.00 Kg', '1.50 Kg') THEN '0.51-1.50 Kg'
    WHEN shipment_weight IN ('2.00 Kg', '3.00 Kg') THEN '1.51-3.00 Kg' ELSE '3.00+ Kg' END"""

WEIGHT_BAND_KG = """CASE WHEN weight_kg IS NULL THEN NULL WHEN weight_kg <= 0.1 THEN '0-0.10 Kg'
    WHEN weight_kg <= 0.5 THEN '0.11-0.50 Kg' WHEN weight_kg <= 1.5 THEN '0.51-1.50 Kg'
    WHEN weight_kg <= 3 THEN '1.51-3.00 Kg' ELSE '3.00+ Kg' END"""


@register("n10_phone_type", over_shipments(f"SELECT id, shipper_phone, {PHONE_TYPE} AS phone_type FROM ship"))
def n10(spark, sf):
    return shipments(spark, sf).select("id", "shipper_phone", N.phone_type(F.col("shipper_phone")).alias("phone_type"))


@register("n11_reference_type", over_shipments(f"SELECT id, {REFERENCE_TYPE} AS reference_type FROM ship"))
def n11(spark, sf):
    kind = N.reference_type(F.col("shipment_reference_number"))
    return shipments(spark, sf).select("id", kind.alias("reference_type"))


@register("n12_weight_band", over_shipments(f"SELECT id, {WEIGHT_BAND} AS weight_band FROM ship"))
def n12(spark, sf):
    return shipments(spark, sf).select("id", N.weight_band(F.col("shipment_weight")).alias("weight_band"))


@register("n12_weight_band_kg", over_shipments(f"SELECT id, {WEIGHT_BAND_KG} AS weight_band FROM ship"))
def n12_kg(spark, sf):
    return shipments(spark, sf).select("id", N.weight_band_kg(F.col("weight_kg")).alias("weight_band"))


@register(
    "n13_boxes_int",
    over_shipments("SELECT id, coalesce(TRY_CAST(number_of_shipment_boxes AS INT), -1) AS boxes FROM ship"),
)
def n13(spark, sf):
    boxes = F.coalesce(N.boxes_int(F.col("number_of_shipment_boxes")), F.lit(-1))
    return shipments(spark, sf).select("id", boxes.alias("boxes"))


# Unicode white space and bidirectional marks in the notation of DuckDB.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MARKS = r"[\x{200e}\x{200f}\x{202a}-\x{202e}]"


def _cleaned(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(coalesce({text}, ''), '^{_SPACE}', ''), "
        f"'{_SPACE}$', ''), '{_MARKS}', '', 'g')"
    )


@register("n14_clean_text", f"SELECT doc_id, {_cleaned('text')} AS text FROM documents")
def n14(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.select("doc_id", N.clean_text(F.col("text")).alias("text"))


@register(
    "n15_presentation_forms",
    r"SELECT doc_id, regexp_matches(text, '[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]') AS shaped FROM documents",
)
def n15(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.select("doc_id", N.has_presentation_forms(F.col("text")).alias("shaped"))


@register("n16_valid_utf8", "SELECT doc_id, 'a' || chr(65533) || chr(64976) || text AS text FROM documents")
def n16(spark, sf):
    """Two bytes that are no valid UTF-8 are put in front of every text and dropped again, a genuine U+FFFD is not."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    broken = F.concat(F.lit(bytearray(b"\xffa\xef\xbf\xbd\xfe\xef\xb7\x90")), F.encode("text", "UTF-8")).cast("string")
    return documents.select("doc_id", N.valid_utf8(broken).alias("text"))


@register("n17_to_dmy", over_shipments("SELECT id, strftime(created_at, '%d-%b-%y') AS created FROM ship"))
def n17(spark, sf):
    return shipments(spark, sf).select("id", N.to_dmy(F.col("created_at")).alias("created"))


@register(
    "n18_pack_params",
    """SELECT p_partkey, '{"filters":{"shipper_city":"' || p_brand || '"},"columns":["id","' || p_type || '"],'
    || '"report_type":"custom","chart_config":{},"schedule_config":{},"is_public":'
    || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '}' AS parameters FROM part""",
)
def n18_pack(spark, sf):
    packed = N.pack_params(
        filters=F.create_map(F.lit("shipper_city"), "p_brand"),
        columns=F.array(F.lit("id"), "p_type"),
        is_public=F.col("p_size") > 25,
    )
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", packed.alias("parameters"))


@register(
    "n18_unpack_params",
    over_tables(
        "custom_reports",
        """SELECT id, parameters->>'$.filters.shipper_city' AS shipper_city,
        array_to_string(from_json(parameters->'$.columns', '["VARCHAR"]'), ',') AS columns,
        parameters->>'$.report_type' AS report_type, parameters->>'$.chart_config.type' AS chart_type,
        (parameters->>'$.is_public')::BOOLEAN AS is_public FROM custom_reports""",
    ),
)
def n18_unpack(spark, sf):
    given = N.unpack_params(F.col("parameters"))
    return sample.custom_reports(spark, sf).select("id", given.alias("given")).select(
        "id",
        F.col("given.filters")["shipper_city"].alias("shipper_city"),
        F.array_join("given.columns", ",").alias("columns"),
        F.col("given.report_type").alias("report_type"),
        F.col("given.chart_config")["type"].alias("chart_type"),
        F.col("given.is_public").alias("is_public"),
    )


@register(
    "n19_plain_functions",
    over_shipments(
        """SELECT id, coalesce(shipper_city, '-') || ' > ' || coalesce(nullif(trim(consignee_city), ''), '-') AS route,
        substr(number_shipment, 3, 9) AS serial, CAST(substr(number_shipment, 3, 9) AS BIGINT) AS serial_number,
        CAST(round(weight_kg, 1) AS DOUBLE) AS weight_1 FROM ship"""
    ),
)
def n19(spark, sf):
    city = F.nullif(F.trim("consignee_city"), F.lit(""))
    serial = F.substring("number_shipment", 3, 9)
    return shipments(spark, sf).select(
        "id",
        F.concat(F.coalesce("shipper_city", F.lit("-")), F.lit(" > "), F.coalesce(city, F.lit("-"))).alias("route"),
        serial.alias("serial"),
        serial.cast("bigint").alias("serial_number"),
        F.round("weight_kg", 1).cast("double").alias("weight_1"),
    )


_SHOWN = [name for name in SHIPMENT_COLUMNS if name not in ("id", "created_at")]


@register(
    "clean_for_display",
    over_shipments("SELECT id, " + ", ".join(f"{_cleaned(name)} AS {name}" for name in _SHOWN) + " FROM ship"),
)
def x02(spark, sf):
    from ..sources.sinks import clean_for_display

    return clean_for_display(shipments(spark, sf).select("id", *_SHOWN))


assert set(_SMALL) == set(TABLES)
