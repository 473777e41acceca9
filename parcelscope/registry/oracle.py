"""DuckDB text of the test tables, written apart from the Spark rules so that each checks the other."""

from __future__ import annotations

from ..sources.sample import GUARDED

# Month names with their numbers.
_MONTHS = {
    "Jan": "01",
    "Feb": "02",
    "Mar": "03",
    "Apr": "04",
    "May": "05",
    "Jun": "06",
    "Jul": "07",
    "Aug": "08",
    "Sep": "09",
    "Oct": "10",
    "Nov": "11",
    "Dec": "12",
}


def month_case(text: str) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{name}' THEN '{number}'" for name, number in _MONTHS.items()) + " END"


def ymd(text: str) -> str:
    month = month_case(f"substr({text}, 4, 3)")
    return (
        f"CASE WHEN {text} LIKE '__-___-__' "
        f"THEN '20' || substr({text}, 8, 2) || {month} || substr({text}, 1, 2) ELSE {text} END"
    )


def amount(text: str) -> str:
    digits = f"regexp_replace(trim({text}), '[^0-9.]', '', 'g')"
    led = f"regexp_replace({digits}, '^[.]', '0.', 'g')"
    return f"TRY_CAST(nullif(regexp_replace({led}, '[.]$', '', 'g'), '') AS DECIMAL(18,4))"


SHIPMENT_COLUMNS = (
    "id, number_shipment, country_code, shipper_city, shipper_phone, shipper_name, shipper_address, consignee_city, "
    "consignee_phone, consignee_name, consignee_address, shipment_reference_number, shipment_creation_date, cod, "
    "shipment_weight, number_of_shipment_boxes, shipment_description, pdf_filename, processing_date, created_at"
)

_SHIPMENTS = f"""
li AS (SELECT l_orderkey, min(l_suppkey) AS sk, count(*) AS boxes FROM lineitem GROUP BY l_orderkey),
parts AS (
  SELECT o_orderkey AS k, s_suppkey, s_name, CAST(s_suppkey AS VARCHAR) AS key, sn.n_name AS s_city, c_custkey, c_name,
    c_mktsegment, cn.n_name AS c_city, cn.n_regionkey AS c_region, boxes, o_orderpriority,
    CAST(o_orderdate AS DATE) + INTERVAL 24 YEARS AS made
  FROM orders
  LEFT JOIN li ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = sk
  LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey
),
raw AS (
  SELECT 3 * k + 1 AS id, 'SH' || lpad(CAST(k AS VARCHAR), 9, '0') AS number_shipment,
    CASE c_region WHEN 0 THEN 'SA' WHEN 1 THEN 'AE' ELSE 'KW' END AS country_code,
    s_city AS shipper_city,
    CASE WHEN s_suppkey % 5 = 0 THEN '05' || lpad(key, 8, '0') WHEN s_suppkey % 5 = 1 THEN '9200' || lpad(key, 5, '0')
      WHEN s_suppkey % 5 = 2 THEN '800' || lpad(key, 7, '0') WHEN s_suppkey % 5 = 3 THEN '+966' || key END
      AS shipper_phone,
    CASE WHEN k % 89 = 0 THEN '' ELSE s_name END AS shipper_name,
    'Street ' || CAST(s_suppkey % 17 AS VARCHAR) AS shipper_address,
    CASE WHEN k % 83 = 0 THEN NULL WHEN k % 79 = 0 THEN '' WHEN k % 73 = 0 THEN 'NULL' ELSE c_city END
      AS consignee_city,
    '05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS consignee_phone,
    c_name AS consignee_name,
    c_mktsegment || ' block ' || CAST(c_custkey % 31 AS VARCHAR) AS consignee_address,
    CASE k % 4 WHEN 0 THEN 'SAL' || k::VARCHAR WHEN 1 THEN k::VARCHAR WHEN 2 THEN k::VARCHAR || '-' || (k % 7)::VARCHAR
      ELSE 'REF_' || k::VARCHAR END AS shipment_reference_number,
    CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN '' WHEN k % 107 = 0 THEN strftime(made, '%Y%m%d')
      WHEN k % 109 = 0 THEN upper(strftime(made, '%d-%b-%y')) WHEN k % 113 = 0 THEN 'N/A'
      ELSE strftime(made, '%d-%b-%y') END AS shipment_creation_date,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN NULL WHEN 3 THEN 'SAR 0.00'
      ELSE 'SAR ' || (k % 500)::VARCHAR || '.25' END AS cod,
    CASE k % 16 WHEN 0 THEN '0.10 Kg' WHEN 1 THEN '0.20 Kg' WHEN 2 THEN '0.30 Kg' WHEN 3 THEN '0.50 Kg'
      WHEN 4 THEN '1.00 Kg' WHEN 5 THEN '1.50 Kg' WHEN 6 THEN '2.00 Kg' WHEN 7 THEN '3.00 Kg' WHEN 8 THEN NULL
      WHEN 9 THEN '' WHEN 10 THEN 'N/A' WHEN 11 THEN '.75' WHEN 12 THEN '5.' WHEN 13 THEN '1.2.3'
      ELSE (k % 40)::VARCHAR || '.25 Kg' END AS shipment_weight,
    boxes::VARCHAR AS number_of_shipment_boxes,
    o_orderpriority AS shipment_description,
    CASE WHEN k % 50 <> 0 THEN 'label_' || k::VARCHAR || '.pdf' END AS pdf_filename,
    CASE WHEN k % 90 <> 0 THEN strftime(made + to_days((k % 5)::INT), '%Y-%m-%d') END AS processing_date,
    CAST(made AS TIMESTAMP) AS created_at
  FROM parts
),
ship AS (
  SELECT *, {ymd('shipment_creation_date')} AS creation_ymd, {amount('shipment_weight')} AS weight_kg,
    {amount('cod')} AS cod_amount
  FROM raw
)"""

_CREATED = "TIMESTAMP '2025-01-01 00:00:00' + to_hours(CAST({key} % 5000 AS INT))"

_GUARDED = ", ".join("'" + text.replace("'", "''") + "'" for text in GUARDED)

_TABLES = {
    "guarded_texts": f"""guarded_texts AS (
  SELECT p_partkey AS id, p_partkey % {len(GUARDED)} AS kind,
    replace(([{_GUARDED}])[p_partkey % {len(GUARDED)} + 1], '{{}}', p_name) AS sql_query FROM part)""",
    "custom_reports": f"""custom_reports AS (
  SELECT p_partkey + 1 AS id, p_name || ' ' || (p_partkey % 97)::VARCHAR AS report_name,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS description,
    CASE p_partkey % 4
      WHEN 1 THEN 'SELECT shipper_city AS city, count(*) AS shipments FROM shipments GROUP BY shipper_city ORDER BY shipments DESC, city'
      WHEN 2 THEN 'SELECT country_code, sum(cod_amount) AS cod FROM shipments GROUP BY country_code ORDER BY country_code'
      WHEN 3 THEN 'SELECT count(*) AS shipments FROM shipments WHERE shipper_phone LIKE concat(''%'', :phone_number, ''%'')'
      ELSE '' END AS sql_query,
    '{{"filters":{{"shipper_city":"NATION_' || (p_size % 25)::VARCHAR || '","min_weight":"1"}},'
      || '"columns":["id","shipper_city","shipment_weight"],"report_type":"custom","chart_config":{{"type":"bar"}},'
      || '"schedule_config":{{}},"is_public":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}'
      AS parameters,
    {_CREATED.format(key='p_partkey')} AS created_at, CAST(NULL AS TIMESTAMP) AS last_executed,
    CAST(0 AS INT) AS execution_count, 'default_user' AS user_id
  FROM part)""",
    "saved_searches": f"""saved_searches AS (
  SELECT c_custkey AS id, c_name AS title, c_mktsegment AS description,
    '{{"consignee_city":"NATION_' || c_nationkey::VARCHAR || '"}}' AS filters,
    {_CREATED.format(key='c_custkey')} AS created_at, {_CREATED.format(key='(c_custkey * 7)')} AS last_used_at,
    CAST(c_custkey % 11 AS INT) AS usage_count, 'default_user' AS user_id
  FROM customer)""",
    "scheduled_reports": f"""scheduled_reports AS (
  SELECT o_orderkey + 1 AS id, o_custkey + 1 AS report_id, 'Schedule ' || o_orderkey::VARCHAR AS schedule_name,
    CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS schedule_type,
    '09:00:00' AS schedule_time, '[]' AS schedule_days, '[]' AS email_recipients, o_orderpriority AS email_subject,
    '' AS email_body, o_orderstatus <> 'F' AS is_active,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS next_run_at, CAST(NULL AS TIMESTAMP) AS last_run_at,
    {_CREATED.format(key='o_orderkey')} AS created_at, {_CREATED.format(key='o_orderkey')} AS updated_at,
    'default_user' AS user_id
  FROM orders)""",
    "dashboard_widgets": f"""dashboard_widgets AS (
  SELECT p_partkey AS id, p_name AS widget_name, p_type AS description, 'number_card' AS widget_type,
    'SELECT count(*) AS shipments, sum(weight_kg) AS weight_kg FROM shipments '
      || 'WHERE creation_month BETWEEN date_format(:start_date, ''yyyyMM'') AND date_format(:end_date, ''yyyyMM'') '
      || 'AND creation_date BETWEEN to_date(:start_date) AND to_date(:end_date)' AS sql_query,
    'activity' AS icon, '#3B82F6' AS color,
    CASE p_partkey % 5 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'this_week' WHEN 3 THEN 'this_month'
      ELSE 'custom' END AS date_range,
    CAST((p_partkey * 13) % 1000 AS INT) AS position, p_size % 7 <> 0 AS is_active,
    {_CREATED.format(key='p_partkey')} AS created_at, {_CREATED.format(key='p_partkey')} AS updated_at,
    'default_user' AS user_id
  FROM part)""",
    "changes": """changes AS (
  SELECT event_id AS seq, ts AS changed_at, user_id,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' WHEN 'click' THEN 'patch'
      WHEN 'error' THEN 'delete' ELSE 'set_active' END AS op,
    CASE WHEN event_type <> 'signup' THEN user_id + 1 END AS id
  FROM events WHERE event_type <> 'error' OR user_id % 7 = 0)""",
    "report_changes": """report_changes AS (
  SELECT seq, changed_at, op, id, 'Report ' || seq::VARCHAR AS report_name,
    CASE WHEN seq % 2 = 0 THEN 'changed' END AS description, CASE WHEN seq % 3 = 0 THEN 'SELECT 1' END AS sql_query,
    CASE WHEN seq % 5 = 0 THEN '{}' END AS parameters
  FROM changes WHERE op IN ('insert', 'update', 'delete'))""",
    "named_reports": "named_reports AS (SELECT * REPLACE (report_name || ' #' || id::VARCHAR AS report_name) FROM custom_reports)",
    "name_changes": """name_changes AS (
  SELECT seq, changed_at, op, c.id,
    CASE WHEN op <> 'delete' THEN coalesce(r.report_name, 'Shared ' || (seq // 200 * 16 + seq * 7 % 16)::VARCHAR) END AS report_name
  FROM changes c LEFT JOIN named_reports r ON seq % 4 = 0 AND r.id = (seq * 11) % 1900 + 1
  WHERE op IN ('insert', 'update', 'delete'))""",
    "search_changes": """search_changes AS (
  SELECT seq, changed_at, op, id, 'Search ' || seq::VARCHAR AS title,
    CASE WHEN seq % 2 = 0 THEN 'changed' END AS description, '{"cod":"yes"}' AS filters
  FROM changes WHERE op IN ('insert', 'update', 'delete'))""",
    "schedule_changes": """schedule_changes AS (
  SELECT seq, changed_at, op, id, user_id + 1 AS report_id, 'Schedule ' || seq::VARCHAR AS schedule_name,
    CASE WHEN seq % 2 = 0 THEN 'weekly' END AS schedule_type, CASE WHEN seq % 3 = 0 THEN '10:30:00' END AS schedule_time,
    CASE WHEN seq % 5 = 0 THEN 'subject' END AS email_subject,
    CASE WHEN op = 'set_active' THEN seq % 2 = 0 END AS is_active
  FROM changes WHERE op IN ('insert', 'update', 'set_active'))""",
    "widget_changes": """widget_changes AS (
  SELECT seq, changed_at, op, id,
    CASE WHEN seq % 2 = 0 OR op = 'insert' THEN 'Widget ' || seq::VARCHAR END AS widget_name,
    CASE WHEN seq % 3 = 0 THEN 'patched' END AS description, CASE WHEN op = 'insert' THEN 'SELECT 1' END AS sql_query,
    CASE WHEN seq % 5 = 0 THEN 'this_week' END AS date_range, CASE WHEN op = 'set_active' THEN false END AS is_active
  FROM changes WHERE op IN ('insert', 'patch', 'set_active'))""",
    "usage_events": "usage_events AS (SELECT user_id + 1 AS id, ts AS used_at FROM events)",
    "widget_order": """widget_order AS (
  SELECT s_suppkey AS id, (SELECT max(s_suppkey) FROM supplier) - s_suppkey AS index FROM supplier)""",
}


def over_shipments(body: str) -> str:
    """``body`` with the shipments view ``ship`` in front; ``body`` may begin with further named parts."""
    return _with(_SHIPMENTS, body)


def over_tables(names: str, body: str) -> str:
    """``body`` with the named small tables in front."""
    return _with(",\n".join(_TABLES[name] for name in names.split()), body)


def _with(head: str, body: str) -> str:
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
