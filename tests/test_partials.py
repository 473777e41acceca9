"""Monthly partials against the same questions over rows, and ordered CSV parts."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from parcelscope.plans import analytics, partials, reports
from parcelscope.sources import export_csv_parts, sample

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    return sample.shipment_partials(spark, SF_DIR)


WINDOWS = [(None, None), ("2024-03-15", "2024-03-20"), ("2024-03-15", "2024-04-02"), ("2023-11-30", "2024-08-01"), ("2019-01-01", "2019-02-01"), ("2024-05-01", "2024-04-01")]


@pytest.mark.parametrize(("start", "end"), WINDOWS)
def test_partials_answer_like_rows(ships, parts, start, end):
    given = {"date_filter": "total", "start": start, "end": end}
    for run in ("top_cities", "total_shipments", "average_weight", "top_customers"):
        exact = getattr(analytics, run)(ships, **given).collect()
        assert getattr(partials, run)(parts, **given).collect() == exact
    assert partials.top_customers(parts, approximate=True, **given).collect() == analytics.top_customers(ships, **given).collect()


def test_reports_from_partials(ships, parts):
    assert partials.top20_cities(parts).collect() == reports.top20_cities(ships).collect()
    assert partials.city_routes(parts).collect() == reports.city_routes(ships).collect()


def test_inner_months_are_not_read_as_rows(parts):
    plan = partials.top_cities(parts, date_filter="total", start="2023-02-10", end="2024-09-20")._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (202302,202409,other)" in plan


def test_sketches_stay_within_their_error(spark):
    many = spark.range(60_000).selectExpr(
        "id", "'c' || CAST(id % 50000 AS STRING) AS consignee_name", "'one' AS shipper_name", "'05' AS shipper_phone",
        "format_string('2024%02d', CAST(id % 12 + 1 AS INT)) AS creation_month",
    )
    # each month has its own sketch; they merge
    sketches = many.groupBy("creation_month", "shipper_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("shipper_phone").alias("phone"), F.hll_sketch_agg("consignee_name", F.lit(partials.SKETCH_BITS)).alias("consignees")
    )
    found = partials.top_customers(partials.Partials(many, many, many, sketches), approximate=True).first()
    assert found["shipment_count"] == 60_000 and abs(found["unique_consignees"] - 50_000) < 4 * 0.0163 * 50_000


def test_parts_put_together_are_one_csv_file(spark, tmp_path):
    rows = [(at, ["plain", 'with "quotes", and commas', "two\nlines", None, "", " spaces "][at % 6], at % 2 == 0) for at in range(200)]
    df = spark.createDataFrame(rows, "id long, `the text` string, flag boolean").repartition(7)
    path = tmp_path / "out"
    export_csv_parts(df, str(path), tasks=5)
    files = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    assert len(files) > 3
    text = "".join(p.read_text(encoding="utf-8") for p in files)
    read = list(csv.reader(io.StringIO(text)))
    assert read[0] == ["id", "the text", "flag"]
    assert read[1:] == [[str(i), t or "", str(f)] for i, t, f in rows]
    empty = tmp_path / "none"
    export_csv_parts(df.limit(0), str(empty), tasks=3)
    assert "".join(p.read_text() for p in sorted(empty.iterdir()) if p.name.startswith("part-")) == 'id,"the text",flag\n'
