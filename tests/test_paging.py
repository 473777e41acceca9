import pytest
from pyspark.sql import functions as F

from parcelscope.operators.paging import BY_DATE, BY_ID, newest_first, page_info, page_rows, rows_after
from parcelscope.operators.ranks import load_counts, newest_rows, rows_between, write_counts
from parcelscope.operators.windows import id_window, latest_n


@pytest.mark.parametrize("order", [BY_ID, BY_DATE])
def test_pages_join_to_the_whole_order(ships, order):
    rows = ships.select("id", "creation_ymd", "creation_month").where("id < 1200")
    whole = [r["id"] for r in newest_first(rows, order).collect()]
    pages = [[r["id"] for r in page_rows(rows, page, 170, order).collect()] for page in (1, 2, 3, 4)]
    assert sum(pages, []) == whole


@pytest.mark.parametrize("order", [BY_ID, BY_DATE])
@pytest.mark.parametrize(("page", "limit"), [(1, 7), (2, 7), (30, 9), (3, 500), (9, 200), (40, 100)])
def test_pages_equal_the_collected_order(ships, order, page, limit):
    rows = [(r["creation_ymd"], r["id"]) for r in ships.select("creation_ymd", "id").collect()]
    rows.sort(key=lambda r: ((r[0] is None, r[0] or ""), r[1]) if order == BY_DATE else r[1], reverse=True)
    found = [(r["creation_ymd"], r["id"]) for r in page_rows(ships, page, limit, order).collect()]
    assert found == rows[(page - 1) * limit : page * limit]


@pytest.mark.parametrize("order", [BY_ID, BY_DATE])
def test_pages_over_repeated_ids_hold_every_row_once(spark, order):
    ids = [20, 20, 20, 18, 18, 7, 7, 7, 7, 1]
    df = spark.createDataFrame([(i, None if i == 18 else "20250101", at) for at, i in enumerate(ids)], "id long, creation_ymd string, at int")
    pages = [[(r["id"], r["at"]) for r in page_rows(df, page, 2, order).collect()] for page in range(1, 7)]
    assert sorted(sum(pages, [])) == sorted((i, at) for at, i in enumerate(ids)) and pages[5] == []
    expected = sorted(ids, reverse=True) if order == BY_ID else [18, 18, 20, 20, 20, 7, 7, 7, 7, 1]
    assert [i for page in pages for i, _ in page] == expected
    assert page_rows(df.limit(0), 2, 5, order).count() == 0


@pytest.mark.parametrize("block_ids", [1, 7, 64, 10**6])
def test_blocks_of_any_size_give_the_same_rows(ships, block_ids):
    rows = ships.select("id", "creation_ymd", "creation_month")
    whole = [r["id"] for r in newest_first(rows, BY_DATE).collect()]
    found = rows_between(rows, 95, 240, True, block_ids=block_ids).orderBy("rank_").collect()
    assert [(r["rank_"], r["id"]) for r in found] == list(enumerate(whole[94:240], start=95))
    newest = [r["id"] for r in newest_rows(rows, 333, block_ids=block_ids).collect()]
    assert sorted(newest) == sorted(r["id"] for r in rows.collect())[-333:]


def test_stored_counts_add_up_over_batches(spark, ships, tmp_path):
    path = str(tmp_path / "counts")
    write_counts(ships.where("id < 1000"), path)
    write_counts(ships.where("id >= 1000"), path)
    counts = load_counts(spark, path)
    for page, order in ((4, BY_ID), (5, BY_DATE)):
        with_counts = [r["id"] for r in page_rows(ships, page, 111, order, counts).collect()]
        assert with_counts == [r["id"] for r in page_rows(ships, page, 111, order).collect()] and len(with_counts) == 111
    assert page_info(ships, 2, 10, counts).first() == page_info(ships, 2, 10).first()
    assert {r["id"] for r in latest_n(ships, 200, counts).collect()} == {r["id"] for r in latest_n(ships, 200).collect()}


def test_a_page_makes_no_job_before_it_is_read(spark, ships):
    spark.sparkContext.setJobGroup("building a page", "")
    page_rows(ships.where("weight_kg > 1"), 50, 10, BY_DATE)
    latest_n(id_window(ships, 2000), 100)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building a page")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_a_page_over_a_window_of_ids(ships):
    rows = id_window(ships, 2000)
    ids = sorted((r["id"] for r in rows.collect()), reverse=True)
    assert [r["id"] for r in page_rows(rows, 3, 50).collect()] == ids[100:150]


def test_next_page_after_a_key(ships):
    rows = ships.select("id", "creation_ymd", "creation_month").where("id < 900")
    whole = newest_first(rows, BY_DATE).collect()
    for at in (3, 40, 200):
        last = whole[at - 1]
        after = rows_after(rows, last["id"], last["creation_ymd"], 25, BY_DATE).collect()
        assert [r["id"] for r in after] == [r["id"] for r in whole[at : at + 25]]


def test_page_info(ships):
    found = page_info(ships, page=15, limit=100).first().asDict()
    assert found == {
        "page": 15,
        "limit": 100,
        "total": 1500,
        "total_pages": 15,
        "has_next": False,
        "has_prev": True,
    }
    empty = page_info(ships.where(F.lit(False)), 1, 10).first()
    assert (empty["total"], empty["total_pages"], empty["has_next"]) == (0, 0, False)


@pytest.mark.parametrize(("page", "limit"), [(0, 10), (1, 0), (-1, 5)])
def test_bad_pages_are_refused(ships, page, limit):
    with pytest.raises(ValueError):
        page_rows(ships, page, limit)
