from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import filters as P
from parcelscope.operators.windows import calendar_range, date_window, id_window, latest_n

AS_OF = date(2025, 8, 1)


@pytest.mark.parametrize(
    ("preset", "window"),
    [
        ("today", ("20250801", "20250801")),
        ("Week", ("20250725", "20250801")),
        ("month", ("20250702", "20250801")),
        ("YEAR", ("20240801", "20250801")),
        ("total", None),
        ("", None),
        (None, None),
        ("2025-03-01", ("20250301", "20250302")),
        ("junk", None),
    ],
)
def test_date_window(preset, window):
    assert date_window(preset, AS_OF) == window


def test_custom_bounds_come_first_and_need_both():
    assert date_window("week", AS_OF, "2025-01-02", "2025-02-03") == ("20250102", "20250203")
    assert date_window("today", AS_OF, start="2025-01-02") == ("20250801", "20250801")


def test_calendar_range():
    assert calendar_range("yesterday", AS_OF) == (date(2025, 7, 31), date(2025, 7, 31))
    assert calendar_range("this_week", AS_OF) == (date(2025, 7, 28), AS_OF)
    assert calendar_range("this_month", AS_OF) == (AS_OF, AS_OF)
    assert calendar_range("custom", AS_OF, "2025-06-01", date(2025, 6, 30)) == (date(2025, 6, 1), date(2025, 6, 30))
    assert calendar_range("decade", AS_OF) == (AS_OF, AS_OF)


def test_a_bound_that_is_no_number_is_refused():
    with pytest.raises(ValueError, match="no number"):
        P.weight_above("heavy")


def test_id_window_keeps_at_most_n(ships):
    assert id_window(ships, 300).count() == 100
    assert latest_n(ships, 300).count() == 300


def test_latest_n_is_exact_with_gaps_and_small_buckets(spark):
    from parcelscope.operators.ranks import newest_rows

    ids = [1, 2, 3, 1_000, 1_001, 500_000, 500_007, 10_000_000_000]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    newest = sorted(ids, reverse=True)
    for n in range(1, len(ids) + 1):
        assert sorted((r["id"] for r in newest_rows(df, n, block_ids=4).collect()), reverse=True) == newest[:n]
    assert newest_rows(df, len(ids) + 1, block_ids=4).count() == len(ids)
    assert newest_rows(df.limit(0), 1).count() == 0
    assert latest_n(df, 100).count() == len(ids)


def test_like_keeps_wildcards_and_survives_backslashes(spark):
    texts = ["a%b", "axb", r"a\b", "a_b", r"c\%"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")

    def found(value, literal=False):
        return {r["v"] for r in df.where(P.contains_like(F.col("v"), value, literal)).collect()}

    assert found("a%b") == {"a%b", "axb", r"a\b", "a_b"}
    assert found("a_b") == {"a%b", "axb", r"a\b", "a_b"}
    assert found(r"a\%b") == {"a%b"}
    assert found(r"a\xb") == {"axb"}
    assert found(r"a\\b") == {r"a\b"}
    assert found("a_b", literal=True) == {"a_b"}


def test_unknown_column_is_refused(ships):
    with pytest.raises(ValueError, match="no such column"):
        P.filter_by(ships, "id OR 1=1", "x")
    with pytest.raises(ValueError, match="no such column"):
        P.project(ships, ["id", "count(*)"])
    with pytest.raises(ValueError, match="unknown filters"):
        P.search_conditions(nothing="x")


def test_empty_filters_do_nothing(ships):
    every = ships.count()
    assert ships.where(P.all_of(P.search_conditions(id="", cod=None, min_weight="heavy"))).count() == every
    assert ships.where(P.all_of(P.search_conditions(cod="maybe"))).count() == every


def test_window_filter_reaches_partitions_and_parquet(ships):
    from parcelscope.operators.windows import in_window

    plan = ships.where(in_window(date_window("month", AS_OF))).select("consignee_city")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "creation_month" in text.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(creation_ymd,20250702)" in text
    assert "shipper_name" not in text.split("ReadSchema")[1]
