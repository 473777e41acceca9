"""Orders and pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import total
from .ranks import ROWS, newest_order, rows_between
from .windows import created_to

BY_ID = "id"
BY_DATE = "date"


class Page(NamedTuple):
    rows: DataFrame
    info: DataFrame


def newest_first(df: DataFrame, order: str = BY_ID) -> DataFrame:
    """By id, or by normalised date with undated rows first and the id as tie-break; repeated ids in an order of their own."""
    return df.orderBy(*newest_order(df, order == BY_DATE))


def _check(page: int, limit: int) -> None:
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")


def first_rows(df: DataFrame, limit: int, order: str = BY_ID) -> DataFrame:
    return page_rows(df, 1, limit, order)


def page_rows(
    df: DataFrame, page: int = 1, limit: int = 20, order: str = BY_ID, counts: DataFrame | None = None
) -> DataFrame:
    """Rows of one page, found by counting what is before them; nothing is before the first page, which is a top-k.

    ``counts`` are the stored counts of exactly the rows of ``df`` (``ranks.load_counts``); without them the rows are counted.
    """
    _check(page, limit)
    if page == 1:
        return newest_first(df, order).limit(limit)
    first = (page - 1) * limit + 1
    found = rows_between(df, first, first + limit - 1, order == BY_DATE, counts)
    return found.orderBy("rank_").drop("rank_")


def rows_after(df: DataFrame, id_: int, day: str | None = None, limit: int = 20, order: str = BY_ID) -> DataFrame:
    """The next rows after the one with this id (and date, in the order by date), where a reader goes from page to page.

    Reads only what is older than the key. Rows that share the whole key are taken as seen.
    """
    _check(1, limit)
    older = F.col("id") < id_
    if order == BY_DATE:
        ymd = F.col("creation_ymd")
        same = ymd.eqNullSafe(F.lit(day)) & older
        older = same | ymd.isNotNull() if day is None else created_to(day) & (same | (ymd < day))
    return newest_first(df.where(older), order).limit(limit)


def page_info(df: DataFrame, page: int = 1, limit: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """One row: page, limit, total, total_pages, has_next, has_prev."""
    _check(page, limit)
    found = total(df) if counts is None else counts.agg(F.coalesce(F.sum(ROWS), F.lit(0)).alias("total"))
    pages = F.expr(f"(total + {limit - 1}) div {limit}")
    return found.select(
        F.lit(page).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("limit"),
        "total",
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def paginate(
    df: DataFrame, page: int = 1, limit: int = 20, order: str = BY_ID, counts: DataFrame | None = None
) -> Page:
    """Rows and facts of one page over the same filtered plan."""
    return Page(page_rows(df, page, limit, order, counts), page_info(df, page, limit, counts))
