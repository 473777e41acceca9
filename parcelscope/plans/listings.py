"""Filtered and paged listings. Each takes normalised or raw shipments and returns their own columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import all_of, checked, present, search_conditions, weight_above
from ..operators.paging import BY_DATE, BY_ID, Page, first_rows, paginate
from ..operators.search import SEARCH_COLUMNS, matches_search, search_index, search_text
from ..operators.substrings import GramIndex, where_contains
from ..operators.windows import date_window, in_window
from ..schema import SHIPMENT_COLUMNS
from ..sources import normalise


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[name for name in SHIPMENT_COLUMNS if name in df.columns])


def _page(rows: DataFrame, page: int, limit: int, order: str, counts: DataFrame | None = None) -> Page:
    found = paginate(rows, page, limit, order, counts)
    return Page(_plain(found.rows), found.info)


def list_shipments(
    df: DataFrame,
    page: int = 1,
    limit: int = 10,
    date_filter: str | None = None,
    start: str | None = None,
    end: str | None = None,
    as_of: date | None = None,
    counts: DataFrame | None = None,
) -> Page:
    """Newest shipments by id. ``counts`` are the stored counts of all of ``df``; a date window takes its part of them."""
    window = date_window(date_filter, as_of, start, end)
    if counts is not None and window is not None:
        counts = counts.where(F.col("creation_ymd").between(window.start, window.end))
    return _page(normalise(df).where(in_window(window)), page, limit, BY_ID, counts)


def filter_shipments(
    df: DataFrame,
    column: str,
    value: str,
    date_filter: str | None = None,
    page: int = 1,
    limit: int = 20,
    as_of: date | None = None,
    grams: GramIndex | None = None,
) -> Page:
    """Rows whose column, whatever its type, contains the value; ``grams`` spares the scan of an indexed column."""
    if not column or not value:
        raise ValueError("column and value are required")
    checked(df, column)
    rows = normalise(df).where(in_window(date_window(date_filter, as_of)))
    return _page(where_contains(rows, column, value, grams), page, limit, BY_DATE)


def recent_shipments(
    df: DataFrame, limit: int = 20, date_filter: str | None = None, as_of: date | None = None
) -> DataFrame:
    """Newest rows that have a creation date, within the window of a preset when one is given."""
    window = date_window(date_filter, as_of)
    rows = df if window is None else normalise(df).where(in_window(window))
    return _plain(first_rows(rows.where(present(F.col("shipment_creation_date"))), limit))


def advanced_search(df: DataFrame, page: int = 1, limit: int = 20, **filters) -> Page:
    """All given filters must hold; see :func:`parcelscope.operators.filters.search_conditions`."""
    return _page(normalise(df).where(all_of(search_conditions(**filters))), page, limit, BY_DATE)


def _newest_where(df: DataFrame, found: Column, date_filter: str | None, limit: int, as_of: date | None) -> DataFrame:
    rows = normalise(df).where(found & in_window(date_window(date_filter, as_of)))
    return _plain(first_rows(rows, limit, BY_DATE))


def by_weight(
    df: DataFrame,
    min_weight: float = 0,
    date_filter: str | None = None,
    limit: int = 50,
    as_of: date | None = None,
) -> DataFrame:
    return _newest_where(df, weight_above(min_weight), date_filter, limit, as_of)


def _newest_named(
    df: DataFrame, column: str, value: str, date_filter: str | None, limit: int, as_of: date | None, grams: GramIndex | None
) -> DataFrame:
    if not value:
        raise ValueError(f"{column} is required")
    rows = normalise(df).where(in_window(date_window(date_filter, as_of)))
    return _plain(first_rows(where_contains(rows, column, value, grams), limit, BY_DATE))


def by_shipper(
    df: DataFrame,
    shipper_name: str,
    date_filter: str | None = None,
    limit: int = 50,
    as_of: date | None = None,
    grams: GramIndex | None = None,
) -> DataFrame:
    return _newest_named(df, "shipper_name", shipper_name, date_filter, limit, as_of, grams)


def by_consignee(
    df: DataFrame,
    consignee_name: str,
    date_filter: str | None = None,
    limit: int = 50,
    as_of: date | None = None,
    grams: GramIndex | None = None,
) -> DataFrame:
    return _newest_named(df, "consignee_name", consignee_name, date_filter, limit, as_of, grams)


def search_shipments(
    df: DataFrame,
    query: str,
    date_filter: str | None = None,
    page: int = 1,
    limit: int = 20,
    columns: tuple[str, ...] = SEARCH_COLUMNS,
    index: DataFrame | None = None,
    as_of: date | None = None,
) -> Page:
    """Full-text search over the joined columns; with an ``index`` of them, only its postings are read to find ids."""
    if not query or not query.strip():
        raise ValueError("query is required")
    rows = normalise(df).where(in_window(date_window(date_filter, as_of)))
    if index is None:
        rows = rows.where(matches_search(search_text(*columns), query))
    else:
        rows = rows.join(search_index(index, query, universe=df), "id", "left_semi")
    return _page(rows, page, limit, BY_DATE)
