import csv
import glob

import pytest
from pyspark.sql import functions as F

from parcelscope.schema import CUSTOM_REPORTS, SHIPMENT_COLUMNS
from parcelscope.sources import (
    ensure_tables,
    export_csv,
    from_json_rows,
    from_rows,
    load_jdbc,
    load_shipments,
    load_table,
    publish,
    sample,
    with_defaults,
    write_normalised,
)
from parcelscope.sources import scratch

SF_DIR = "/root/testdata/sf0.001"


def test_ragged_rows(spark):
    df = from_rows(spark, [{"b": 1, "a": "x"}, {"c": 2.5, "b": None}, {"a": 3, "c": 1}])
    assert df.columns == ["b", "a", "c"]
    assert [tuple(r) for r in df.collect()] == [(1, "x", None), (None, None, 2.5), (None, "3", 1.0)]
    assert from_rows(spark, []).count() == 0


def test_json_rows(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',), ("broken",)], "j string")
    assert [tuple(r) for r in from_json_rows(df, "j", ["a", "b"]).collect()] == [("1", None), (None, "x"), (None, None)]


def test_raw_parquet_round_trip(spark, ships, tmp_path):
    raw, stored = str(tmp_path / "raw"), str(tmp_path / "stored")
    ships.select(*SHIPMENT_COLUMNS).write.parquet(raw)
    loaded = load_shipments(spark, raw)
    write_normalised(loaded, stored, 3)
    again = load_shipments(spark, stored, normalised=True)
    assert loaded.select(*again.columns).exceptAll(again).count() == 0
    assert again.count() == 1500


def test_a_large_month_is_written_by_many_tasks(spark, ships, tmp_path, monkeypatch):
    from parcelscope.sources import normalised

    monkeypatch.setattr(normalised, "IDS_PER_FILE", 100)
    one_month = ships.select(*SHIPMENT_COLUMNS).withColumn("shipment_creation_date", F.lit("05-Oct-25"))
    write_normalised(one_month, str(tmp_path / "hot"), 8)
    assert len(glob.glob(str(tmp_path / "hot" / "creation_month=202510" / "*.parquet"))) > 4


def test_csv_quotes_and_empty_values(spark, tmp_path):
    rows = [("a", 'say "hi"', "x,y"), ("b", None, ""), ("c", "line\nbreak", "\\"), ("d", "  in  ", "\t")]
    path = str(tmp_path / "out")
    counted = export_csv(spark.createDataFrame(rows, "k string, q string, v string"), path)
    assert counted.get["records"] == 4
    read = []
    for part in glob.glob(f"{path}/*.csv"):
        with open(part, newline="", encoding="utf-8") as file:
            header, *lines = list(csv.reader(file))
            assert header == ["k", "q", "v"]
            read += lines
    assert sorted(read) == [["a", 'say "hi"', "x,y"], ["b", "", ""], ["c", "line\nbreak", "\\"], ["d", "  in  ", "\t"]]


def test_csv_values_that_are_no_text(spark, tmp_path):
    path = str(tmp_path / "typed")
    rows = spark.sql("SELECT true AS b, 1.5D AS d, 7 AS i, timestamp_ntz'2025-08-01 10:00:00' AS t, array(1, 2) AS a")
    export_csv(rows, path)
    (part,) = glob.glob(f"{path}/*.csv")
    with open(part, newline="", encoding="utf-8") as file:
        assert list(csv.reader(file))[1] == ["True", "1.5", "7", "2025-08-01 10:00:00", "[1,2]"]


def test_tables_are_created_once_and_versions_switch(spark, tmp_path):
    spark.sql(f"CREATE DATABASE meta LOCATION '{tmp_path}/db'")
    folder = str(tmp_path / "tables")
    assert len(ensure_tables(spark, folder, "meta")) == 4
    assert ensure_tables(spark, folder, "meta") == []
    assert load_table(spark, "custom_reports", "meta").count() == 0
    publish(sample.custom_reports(spark, SF_DIR), "custom_reports", folder, "meta")
    first = load_table(spark, "custom_reports", "meta")
    count = first.count()
    assert count == 200
    # A new version may be computed from the one that is being read.
    publish(first.where("id <= 50"), "custom_reports", folder, "meta")
    assert load_table(spark, "custom_reports", "meta").count() == 50
    with pytest.raises(ValueError):
        load_table(spark, "customers", "meta")


def test_defaults(spark):
    row = with_defaults(spark.createDataFrame([(1, "n")], "id long, report_name string"), "custom_reports").first()
    assert row["parameters"] == "{}" and row["execution_count"] == 0 and row["user_id"] == "default_user"
    assert row["created_at"] is not None and row["last_executed"] is None
    assert list(row.asDict()) == CUSTOM_REPORTS.fieldNames()


def test_jdbc_reads_by_ranges_of_id():
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **options):
            seen.update(options)
            return self

        def load(self):
            return "frame"

    class Session:
        read = Reader()

    assert load_jdbc(Session(), "jdbc:postgresql://h/d", "shipments", 0, 10**9, 200, user="u", password="p") == "frame"
    assert seen["format"] == "jdbc" and seen["partitionColumn"] == "id" and seen["numPartitions"] == "200"
    assert seen["user"] == "u" and seen["upperBound"] == "1000000000"


class Conf:
    def __init__(self, **settings):
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_scratch_is_the_folder_the_cluster_names():
    class Session:
        conf = Conf(spark_checkpoint_dir="hdfs://shared/dir/", spark_master="yarn")

    assert scratch.scratch_path(Session(), "x").startswith("hdfs://shared/dir/parcelscope/x-")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    class Session:
        conf = Conf(spark_master=master)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session(), "x")


def test_tables_are_derived_by_tasks_that_hold_little_input(spark, monkeypatch):
    from parcelscope.sources import scratch

    given = []
    monkeypatch.setattr(scratch, "_files", lambda spark, paths: (10 << 30, ("mark of this test",)))
    scratch.write_once(spark, "probe", ["nowhere"], lambda to, tasks: given.append(tasks))
    assert given[0] >= 10 * 1024 / 16


def test_ordered_parts_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    from parcelscope.sources import sinks

    path = str(tmp_path / "parts")
    monkeypatch.setattr(sinks, "ROWS_PER_PART", 100, raising=False)
    sinks.export_csv_parts(spark.range(2000).selectExpr("id", "'x' || id AS name"), path)
    parts = spark.read.text(path).where("value <> 'id,name'").groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 500 and sum(r["count"] for r in parts) == 2000


def test_shipments_are_sorted_by_tasks_that_hold_less(spark, monkeypatch):
    from parcelscope.sources import sample, scratch

    class Stop(Exception):
        pass

    def stop(df, path, tasks):
        given.append(tasks)
        raise Stop

    given = []
    monkeypatch.setattr(scratch, "_files", lambda spark, paths: (10 << 30, ("mark of the sort test",)))
    monkeypatch.setattr(sample, "write_normalised", stop)
    monkeypatch.setattr(sample, "raw_shipments", lambda spark, sf_dir: None)
    with pytest.raises(Stop):
        sample.shipments(spark, "nowhere")
    assert given == [10 * 1024 // 4]
