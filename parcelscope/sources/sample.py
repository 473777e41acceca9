"""Test tables: shipments and the small tables derived, at any scale, from the order tables of a data folder.

The rules are those of ``FIXTURES.md``. Shipments are written once per session as the normalised layer, the way a
deployment stores them when they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import load_counts, write_counts
from ..schema import SHIPMENT_COLUMNS
from .normalised import write_normalised
from .scratch import BYTES_PER_SORT, write_once
from .tables import load_shipments

_opened: dict[str, DataFrame] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shipment per order, untidy on purpose."""
    lines = (
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("sk"), F.count(F.lit(1)).alias("boxes"))
    )
    suppliers = _read(spark, sf_dir, "supplier")
    customers = _read(spark, sf_dir, "customer")
    nations = _read(spark, sf_dir, "nation")
    origin = nations.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name"))
    target = nations.select(
        F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"), F.col("n_regionkey").alias("cn_region")
    )
    joined = (
        _read(spark, sf_dir, "orders")
        .repartition("o_orderkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(suppliers, F.col("s_suppkey") == F.col("sk"), "left")
        .join(origin, F.col("s_nationkey") == F.col("sn_key"), "left")
        .join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(target, F.col("c_nationkey") == F.col("cn_key"), "left")
        .withColumn("k", F.col("o_orderkey"))
        .withColumn("key", F.expr("CAST(s_suppkey AS STRING)"))
        .withColumn("made", F.expr("add_months(CAST(o_orderdate AS DATE), 288)"))
        .withColumn("dmy", F.date_format("made", "dd-MMM-yy"))
    )
    rules = {
        "id": "3 * k + 1",
        "number_shipment": "'SH' || lpad(CAST(k AS STRING), 9, '0')",
        "country_code": "CASE cn_region WHEN 0 THEN 'SA' WHEN 1 THEN 'AE' ELSE 'KW' END",
        "shipper_city": "sn_name",
        "shipper_phone": """CASE s_suppkey % 5 WHEN 0 THEN '05' || lpad(key, 8, '0') WHEN 1 THEN '9200' || lpad(key, 5, '0')
            WHEN 2 THEN '800' || lpad(key, 7, '0') WHEN 3 THEN '+966' || key END""",
        "shipper_name": "CASE WHEN k % 89 = 0 THEN '' ELSE s_name END",
        "shipper_address": "'Street ' || CAST(s_suppkey % 17 AS STRING)",
        "consignee_city": """CASE WHEN k % 83 = 0 THEN NULL WHEN k % 79 = 0 THEN '' WHEN k % 73 = 0 THEN 'NULL'
            ELSE cn_name END""",
        "consignee_phone": "'05' || lpad(CAST(c_custkey AS STRING), 8, '0')",
        "consignee_name": "c_name",
        "consignee_address": "c_mktsegment || ' block ' || CAST(c_custkey % 31 AS STRING)",
        "shipment_reference_number": """CASE k % 4 WHEN 0 THEN 'SAL' || CAST(k AS STRING) WHEN 1 THEN CAST(k AS STRING)
            WHEN 2 THEN CAST(k AS STRING) || '-' || CAST(k % 7 AS STRING) ELSE 'REF_' || CAST(k AS STRING) END""",
        "shipment_creation_date": """CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN ''
            WHEN k % 107 = 0 THEN date_format(made, 'yyyyMMdd') WHEN k % 109 = 0 THEN upper(dmy)
            WHEN k % 113 = 0 THEN 'N/A' ELSE dmy END""",
        "cod": """CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN NULL WHEN 3 THEN 'SAR 0.00'
            ELSE 'SAR ' || CAST(k % 500 AS STRING) || '.25' END""",
        "shipment_weight": """CASE k % 16 WHEN 0 THEN '0.10 Kg' WHEN 1 THEN '0.20 Kg' WHEN 2 THEN '0.30 Kg'
            WHEN 3 THEN '0.50 Kg' WHEN 4 THEN '1.00 Kg' WHEN 5 THEN '1.50 Kg' WHEN 6 THEN '2.00 Kg'
            WHEN 7 THEN '3.00 Kg' WHEN 8 THEN NULL WHEN 9 THEN '' WHEN 10 THEN 'N/A' WHEN 11 THEN '.75'
            WHEN 12 THEN '5.' WHEN 13 THEN '1.2.3' ELSE CAST(k % 40 AS STRING) || '.25 Kg' END""",
        "number_of_shipment_boxes": "CAST(boxes AS STRING)",
        "shipment_description": "o_orderpriority",
        "pdf_filename": "CASE WHEN k % 50 <> 0 THEN 'label_' || CAST(k AS STRING) || '.pdf' END",
        "processing_date": """CASE WHEN k % 90 <> 0
            THEN date_format(date_add(made, CAST(k % 5 AS INT)), 'yyyy-MM-dd') END""",
        "created_at": "CAST(made AS TIMESTAMP_NTZ)",
    }
    return joined.select(*[F.expr(rules[name]).alias(name) for name in SHIPMENT_COLUMNS])


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised shipments of a data folder, read from the table that the first call writes."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    path = write_once(
        spark,
        "shipments",
        inputs,
        lambda to, tasks: write_normalised(raw_shipments(spark, sf_dir), to, tasks),
        bytes_per_task=BYTES_PER_SORT,  # rows of one month and range of ids stay in one task, so files don't get more
    )
    if path not in _opened or _opened[path].sparkSession is not spark:
        _opened[path] = load_shipments(spark, path, normalised=True)
    return _opened[path]


def shipment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per date and range of ids, stored beside the shipments."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    return load_counts(spark, write_once(spark, "shipment_counts", inputs, lambda to, _: write_counts(shipments(spark, sf_dir), to)))


def shipment_grams(spark: SparkSession, sf_dir: str):
    """Grams of the shipments' lookup columns, appended in two batches."""
    from ..operators.substrings import add_grams, load_grams

    rows = shipments(spark, sf_dir)

    def write(to: str, tasks: int) -> None:
        add_grams(rows.where("id % 4 = 0"), to, tasks)
        add_grams(rows.where("id % 4 <> 0"), to, tasks)

    inputs = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    return load_grams(spark, write_once(spark, "shipment_grams", inputs, write))


def shipment_partials(spark: SparkSession, sf_dir: str):
    """Monthly partials of the shipments, appended in two batches."""
    from ..plans.partials import add_partials, load_partials

    rows = shipments(spark, sf_dir)

    def write(to: str, _: int) -> None:
        add_partials(rows.where("id % 3 = 0"), to)
        add_partials(rows.where("id % 3 <> 0"), to)

    inputs = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "supplier", "customer", "nation")]
    return load_partials(spark, write_once(spark, "shipment_partials", inputs, write), rows)


_CREATED = "CAST(timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, {key} % 5000) AS TIMESTAMP_NTZ)"


def custom_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored report per part. One in four has no SQL and is built from its filters and columns."""
    texts = {
        1: "SELECT shipper_city AS city, count(*) AS shipments FROM shipments GROUP BY shipper_city ORDER BY shipments DESC, city",
        2: "SELECT country_code, sum(cod_amount) AS cod FROM shipments GROUP BY country_code ORDER BY country_code",
        3: "SELECT count(*) AS shipments FROM shipments WHERE shipper_phone LIKE concat('%', :phone_number, '%')",
    }
    sql = "CASE p_partkey % 4 " + " ".join(f'WHEN {at} THEN "{text}"' for at, text in texts.items()) + " ELSE '' END"
    return _read(spark, sf_dir, "part").select(
        F.expr("p_partkey + 1").alias("id"),
        F.expr("p_name || ' ' || CAST(p_partkey % 97 AS STRING)").alias("report_name"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END").alias("description"),
        F.expr(sql).alias("sql_query"),
        F.expr(
            """'{"filters":{"shipper_city":"NATION_' || CAST(p_size % 25 AS STRING) || '","min_weight":"1"},'
            || '"columns":["id","shipper_city","shipment_weight"],"report_type":"custom","chart_config":{"type":"bar"},'
            || '"schedule_config":{},"is_public":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'"""
        ).alias("parameters"),
        F.expr(_CREATED.format(key="p_partkey")).alias("created_at"),
        F.expr("CAST(NULL AS TIMESTAMP_NTZ)").alias("last_executed"),
        F.expr("CAST(0 AS INT)").alias("execution_count"),
        F.lit("default_user").alias("user_id"),
    )


GUARDED = [
    "SELECT count(*) AS n FROM shipments WHERE shipper_city = '{}'",
    "WITH a AS (SELECT id FROM shipments WHERE shipper_name = '{}'), b AS (SELECT * FROM a) SELECT count(*) FROM b",
    "SELECT s.id FROM shipments s JOIN (SELECT max(id) AS id FROM shipments) m ON s.id = m.id AND s.cod <> '{}'",
    "SELECT id, row_number() OVER (PARTITION BY shipper_city ORDER BY id) AS nth FROM shipments WHERE cod LIKE '%{}'",
    "SELECT shipper_city, count(*) FROM shipments GROUP BY shipper_city HAVING count(*) > 3 OR shipper_city = '{}' ORDER BY 2 LIMIT 5",
    "SELECT id FROM shipments WHERE id IN (SELECT id FROM shipments WHERE cod = '{}') UNION ALL SELECT 1",
    "SELECT 'IDENTIFIER(''{}'')' AS text, 'FROM other' AS words FROM shipments",
    "SELECT b.part FROM shipments LATERAL VIEW explode(split(shipper_name, '{}')) b AS part",
    "SELECT id FROM shipments WHERE shipper_phone LIKE concat('%', :phone_number, '{}')",
    "SELECT * FROM IDENTIFIER('parquet.`/data/{}`')",
    "SELECT * FROM IDENTIFIER('{}')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', '{}') FROM shipments",
    "SELECT * FROM parquet.`/data/file` WHERE name = '{}'",
    "SELECT * FROM other WHERE name = '{}'",
    "SELECT * FROM other WHERE id IN (WITH other AS (SELECT 1 AS id) SELECT id FROM other) AND name = '{}'",
    "SELECT * FROM range(3) WHERE 'x' = '{}'",
    "SELECT reflect('java.lang.System', 'getProperty', '{}') FROM shipments",
    "SELECT input_file_name() FROM shipments WHERE shipper_name = '{}'",
    "SELECT TRANSFORM(id) USING 'cat {}' FROM shipments",
    "INSERT INTO shipments SELECT '{}'",
    'SELECT 1; DROP VIEW shipments -- {}',
    '',
]
"""Texts that the guard of stored SQL lets through (the first nine) and refuses, around a name."""


def guarded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per part, of a kind by its key, with the part's name in its literal."""
    kinds = F.array(*[F.lit(text) for text in GUARDED])
    kind = (F.col("p_partkey") % len(GUARDED)).cast("int")
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), kind.alias("kind"), F.replace(F.get(kinds, kind), F.lit("{}"), F.col("p_name")).alias("sql_query")
    )


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved search per customer."""
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("description"),
        F.expr("""'{"consignee_city":"NATION_' || CAST(c_nationkey AS STRING) || '"}'""").alias("filters"),
        F.expr(_CREATED.format(key="c_custkey")).alias("created_at"),
        F.expr(_CREATED.format(key="(c_custkey * 7)")).alias("last_used_at"),
        F.expr("CAST(c_custkey % 11 AS INT)").alias("usage_count"),
        F.lit("default_user").alias("user_id"),
    )


def scheduled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schedule per order, each of a report."""
    return _read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey + 1").alias("id"),
        F.expr("o_custkey + 1").alias("report_id"),
        F.expr("'Schedule ' || CAST(o_orderkey AS STRING)").alias("schedule_name"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END").alias("schedule_type"),
        F.lit("09:00:00").alias("schedule_time"),
        F.lit("[]").alias("schedule_days"),
        F.lit("[]").alias("email_recipients"),
        F.col("o_orderpriority").alias("email_subject"),
        F.lit("").alias("email_body"),
        F.expr("o_orderstatus <> 'F'").alias("is_active"),
        F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) END").alias("next_run_at"),
        F.expr("CAST(NULL AS TIMESTAMP_NTZ)").alias("last_run_at"),
        F.expr(_CREATED.format(key="o_orderkey")).alias("created_at"),
        F.expr(_CREATED.format(key="o_orderkey")).alias("updated_at"),
        F.lit("default_user").alias("user_id"),
    )


def dashboard_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One widget per part."""
    sql = (
        "SELECT count(*) AS shipments, sum(weight_kg) AS weight_kg FROM shipments "
        "WHERE creation_month BETWEEN date_format(:start_date, 'yyyyMM') AND date_format(:end_date, 'yyyyMM') "
        "AND creation_date BETWEEN to_date(:start_date) AND to_date(:end_date)"
    )
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("widget_name"),
        F.col("p_type").alias("description"),
        F.lit("number_card").alias("widget_type"),
        F.lit(sql).alias("sql_query"),
        F.lit("activity").alias("icon"),
        F.lit("#3B82F6").alias("color"),
        F.expr(
            """CASE p_partkey % 5 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'this_week'
            WHEN 3 THEN 'this_month' ELSE 'custom' END"""
        ).alias("date_range"),
        F.expr("CAST((p_partkey * 13) % 1000 AS INT)").alias("position"),
        F.expr("p_size % 7 <> 0").alias("is_active"),
        F.expr(_CREATED.format(key="p_partkey")).alias("created_at"),
        F.expr(_CREATED.format(key="p_partkey")).alias("updated_at"),
        F.lit("default_user").alias("user_id"),
    )


# Event types as operations on the small tables, so that change batches grow with the events.
_OPERATION = """CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' WHEN 'click' THEN 'patch'
    WHEN 'error' THEN 'delete' ELSE 'set_active' END"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation, order and key of each change. Deletes hit every seventh key only, so that most rows survive."""
    return (
        _read(spark, sf_dir, "events")
        .withColumn("op", F.expr(_OPERATION))
        .withColumn("id", F.expr("CASE WHEN event_type <> 'signup' THEN user_id + 1 END"))
        .where("op <> 'delete' OR user_id % 7 = 0")
        .select(F.col("event_id").alias("seq"), F.col("ts").alias("changed_at"), "op", "id", "user_id", "value")
    )


def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).where("op IN ('insert', 'update', 'delete')")
    return rows.select(
        "seq",
        "changed_at",
        "op",
        "id",
        F.expr("'Report ' || CAST(seq AS STRING)").alias("report_name"),
        F.expr("CASE WHEN seq % 2 = 0 THEN 'changed' END").alias("description"),
        F.expr("CASE WHEN seq % 3 = 0 THEN 'SELECT 1' END").alias("sql_query"),
        F.expr("CASE WHEN seq % 5 = 0 THEN '{}' END").alias("parameters"),
    )


def named_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports under names that no two of them share."""
    name = F.expr("report_name || ' #' || CAST(id AS STRING)")
    return custom_reports(spark, sf_dir).withColumn("report_name", name)


def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that want the names of their neighbours, one in four that of a stored report."""
    stored = named_reports(spark, sf_dir).select(F.col("id").alias("other"), F.col("report_name").alias("stored"))
    rows = _changes(spark, sf_dir).where("op IN ('insert', 'update', 'delete')")
    rows = rows.withColumn("other", F.expr("CASE WHEN seq % 4 = 0 THEN (seq * 11) % 1900 + 1 END")).join(stored, "other", "left")
    return rows.select(
        "seq",
        "changed_at",
        "op",
        "id",
        F.expr("CASE WHEN op <> 'delete' THEN coalesce(stored, 'Shared ' || CAST(seq div 200 * 16 + seq * 7 % 16 AS STRING)) END").alias("report_name"),
    )


def search_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).where("op IN ('insert', 'update', 'delete')")
    return rows.select(
        "seq",
        "changed_at",
        "op",
        "id",
        F.expr("'Search ' || CAST(seq AS STRING)").alias("title"),
        F.expr("CASE WHEN seq % 2 = 0 THEN 'changed' END").alias("description"),
        F.lit('{"cod":"yes"}').alias("filters"),
    )


def schedule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).where("op IN ('insert', 'update', 'set_active')")
    return rows.select(
        "seq",
        "changed_at",
        "op",
        "id",
        F.expr("user_id + 1").alias("report_id"),
        F.expr("'Schedule ' || CAST(seq AS STRING)").alias("schedule_name"),
        F.expr("CASE WHEN seq % 2 = 0 THEN 'weekly' END").alias("schedule_type"),
        F.expr("CASE WHEN seq % 3 = 0 THEN '10:30:00' END").alias("schedule_time"),
        F.expr("CASE WHEN seq % 5 = 0 THEN 'subject' END").alias("email_subject"),
        F.expr("CASE WHEN op = 'set_active' THEN seq % 2 = 0 END").alias("is_active"),
    )


def widget_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).where("op IN ('insert', 'patch', 'set_active')")
    return rows.select(
        "seq",
        "changed_at",
        "op",
        "id",
        F.expr("CASE WHEN seq % 2 = 0 OR op = 'insert' THEN 'Widget ' || CAST(seq AS STRING) END").alias("widget_name"),
        F.expr("CASE WHEN seq % 3 = 0 THEN 'patched' END").alias("description"),
        F.expr("CASE WHEN op = 'insert' THEN 'SELECT 1' END").alias("sql_query"),
        F.expr("CASE WHEN seq % 5 = 0 THEN 'this_week' END").alias("date_range"),
        F.expr("CASE WHEN op = 'set_active' THEN false END").alias("is_active"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of saved searches and runs of reports: (id, used_at)."""
    return _read(spark, sf_dir, "events").select(F.expr("user_id + 1").alias("id"), F.col("ts").alias("used_at"))


def widget_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new order of widgets, (id, index): every supplier key counted from the last."""
    suppliers = _read(spark, sf_dir, "supplier")
    last = suppliers.agg(F.max("s_suppkey")).scalar()
    return suppliers.select(F.col("s_suppkey").alias("id"), (last - F.col("s_suppkey")).alias("index"))
