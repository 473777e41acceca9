from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelscope.plans import analytics, listings, reports, stored
from parcelscope.sources import sample

SF_DIR = "/root/testdata/sf0.001"


def test_shares_sum_to_a_hundred(ships):
    for report in (reports.phone_patterns, reports.reference_types, reports.multi_box):
        found = report(ships).agg(F.sum("Percentage").alias("p"), F.count(F.lit(1)).alias("n")).first()
        if report is reports.multi_box:
            continue
        assert abs(found["p"] - 100) <= 0.005 * found["n"] + 1e-9


def test_multi_box_is_in_numeric_order(ships):
    boxes = [int(r["Boxes"]) for r in reports.multi_box(ships).collect()]
    assert boxes == sorted(boxes)


def test_orders_of_reports(ships):
    counts = [r["Total Shipments"] for r in reports.top20_cities(ships).collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) == 20
    days = [r["Date"] for r in reports.daily_volume(ships).collect()]
    assert days == sorted(days, reverse=True)


def test_recent_is_newest_first(ships):
    ids = [r["id"] for r in listings.recent_shipments(ships, limit=30).collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) == 30


def test_raw_and_stored_rows_give_the_same(spark, ships):
    raw = sample.raw_shipments(spark, SF_DIR)
    options = {"date_filter": "year", "as_of": date(2025, 8, 1)}
    assert analytics.top_cities(raw, **options).collect() == analytics.top_cities(ships, **options).collect()


def test_required_values(ships):
    for call in (
        lambda: listings.filter_shipments(ships, "", "x"),
        lambda: listings.by_shipper(ships, ""),
        lambda: listings.by_consignee(ships, ""),
        lambda: listings.search_shipments(ships, "  "),
    ):
        with pytest.raises(ValueError):
            call()


def test_every_catalogue_report_runs_as_stored_sql(spark, ships):
    assert len(reports.CATALOGUE) == 15
    for report in reports.CATALOGUE:
        found = stored.run_sql(spark, ships, report.sql_query, **report.required)
        columns = tuple(name.format(**report.required) for name in report.columns)
        assert tuple(found.columns) == columns


def test_markers():
    assert stored.to_markers("a LIKE '%{phone}%'") == "a LIKE concat('%', :phone, '%')"
    assert stored.to_markers("a = '{city}' AND b = 'x'") == "a = :city AND b = 'x'"
    assert stored.to_markers("a RLIKE '[0-9]{8}'") == "a RLIKE '[0-9]{8}'"


def test_values_are_bound_not_pasted(spark, ships):
    text = """SELECT count(*) AS "All Rows" FROM shipments WHERE consignee_city = '{city}'"""
    found = stored.run_sql(spark, ships, text, city="x' OR '1' = '1")
    assert found.columns == ["All Rows"] and found.first()[0] == 0
    bare = "SELECT count(*) AS n FROM shipments WHERE consignee_city = {city}"
    assert stored.run_sql(spark, ships, bare, city="'x' OR 1=1").first()[0] == 0
    named = stored.run_sql(spark, ships, 'SELECT count(*) AS "Rows of {city}" FROM shipments', city='a"`b')
    assert named.columns == ["Rows of ab"]


def test_own_names_and_no_traces(spark, ships):
    before = {table.name for table in spark.catalog.listTables()}
    text = "WITH a AS (SELECT id FROM shipments), b AS (SELECT * FROM a) SELECT count(*) AS n FROM b -- it's all"
    first = stored.run_sql(spark, ships.where("id < 100"), text)
    second = stored.run_sql(spark, ships, text)
    assert (first.first()["n"], second.first()["n"]) == (33, 1500)
    assert {table.name for table in spark.catalog.listTables()} == before


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE shipments",
        "INSERT INTO t SELECT 1",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "SELECT 1; DROP VIEW shipments",
        "",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT count(*) FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT (SELECT count(*) FROM other) FROM shipments",
        "SELECT 'CTE [other]' FROM other",
        "SELECT '\nCTE [other]' FROM other",
        "SELECT 1 /* ' */ FROM other",
        "SELECT '\\' FROM other WHERE 'x' = ''",
        "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')",
        "SELECT * FROM IDENTIFIER('default.custom_reports')",
        "SELECT * FROM IDENTIFIER('other')",
        "SELECT * FROM shipments WHERE id IN (SELECT id FROM IDENTIFIER('x' || 'y'))",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM shipments",
        "SELECT * FROM range(3)",
        "SELECT * FROM sql_keywords()",
        "SELECT * FROM shipments, LATERAL explode(array(1))",
        "SELECT * FROM other WHERE id IN (WITH other AS (SELECT 1 AS id) SELECT id FROM other)",
        "SELECT * FROM (WITH other AS (SELECT 1 AS id) SELECT id FROM other) JOIN other USING (id)",
        "SELECT input_file_name() FROM shipments",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT own_function(id) FROM shipments",
        "SELECT TRANSFORM(id) USING 'cat' FROM shipments",
        "SELECT * FROM shipments VERSION AS OF 1",
        "SELECT 1) UNION ALL (SELECT 2",
    ],
)
def test_only_queries_run(spark, ships, text):
    from pyspark.errors import ParseException

    with pytest.raises((ValueError, ParseException)):
        stored.run_sql(spark, ships, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'IDENTIFIER(x) FROM other' AS a FROM shipments",
        "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 3) SELECT i FROM n",
        "SELECT a.id FROM shipments a JOIN shipments b ON a.id = b.id, LATERAL (SELECT a.id + 1) c",
        "SELECT id FROM shipments LATERAL VIEW explode(array(1, 2)) t AS x",
        "SELECT x FROM VALUES (1), (2) AS t(x)",
        "SELECT shipper_city, count(*) FILTER (WHERE cod_amount > 1) FROM shipments GROUP BY ALL HAVING count(*) > 1",
        "SELECT transform(array(id), x -> x + 1), CASE WHEN id BETWEEN 1 AND 2 THEN 'a' || 'b' END FROM shipments",
        "SELECT * FROM (SELECT shipper_city, id FROM shipments) PIVOT (count(id) FOR shipper_city IN ('NATION_1', 'NATION_2'))",
    ],
)
def test_queries_of_all_kinds_run(spark, ships, text):
    stored.run_sql(spark, ships, text).collect()


def test_a_function_of_the_session_does_not_pass_for_a_built_in_one(spark, ships):
    spark.udf.register("own_upper", lambda text: "mine")
    with pytest.raises(ValueError):
        stored.run_sql(spark, ships, "SELECT own_upper(shipper_city) FROM shipments")


def test_refused_texts_read_nothing(spark, ships, tmp_path):
    """A file that does not exist would be an error of another kind if it were looked up."""
    for text in (f"SELECT * FROM parquet.`{tmp_path}/none`", f"SELECT * FROM IDENTIFIER('parquet.`{tmp_path}/none`')"):
        with pytest.raises(ValueError, match="no such view|only SELECT"):
            stored.run_sql(spark, ships, text)


def test_verdicts_over_a_table(spark):
    texts = ["SELECT 1", "SELECT 'a' FROM shipments", "SELECT 'b' FROM shipments", "SELECT * FROM IDENTIFIER('a')", None, ""]
    rows = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "id int, sql_query string")
    found = {row["id"]: row["refused"] for row in stored.verdicts(rows).collect()}
    assert [found[at] is None for at in range(len(texts))] == [True, True, True, False, False, False]


def test_missing_report_and_fallback(spark, ships):
    table = sample.custom_reports(spark, SF_DIR)
    with pytest.raises(LookupError):
        stored.run_report(spark, ships, table, 10**9)
    built = stored.run_report(spark, ships, table, 1)
    assert built.columns == ["id", "shipper_city", "shipment_weight"]


def test_widget_with_text_dates(spark, ships):
    widget = spark.createDataFrame(
        [(1, "SELECT '{start_date}' AS a, '{end_date}' AS b, count(*) AS n FROM shipments", "this_week")],
        "id long, sql_query string, date_range string",
    )
    row = stored.run_widget(spark, ships, widget, 1, date(2025, 8, 1)).first()
    assert (row["a"], row["b"], row["n"]) == ("28-Jul-25", "01-Aug-25", 1500)


def test_summary_is_one_row(ships):
    summary = analytics.analytics_summary(ships, "total")
    row = summary.first()
    assert summary.count() == 1 and len(row["top_cities"]) == 5
    counts = [city["shipment_count"] for city in row["top_cities"]]
    assert counts == sorted(counts, reverse=True)
