"""Windows over the creation date and over the id.

The date windows expect a normalised frame (see :func:`parcelscope.sources.normalise`) and filter on its partition
column as well as on the date, so that whole months are skipped.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from typing import NamedTuple

from dateutil import parser as date_parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import OTHER_MONTH
from .ranks import newest_rows

# Days that a preset reaches back.
DAYS_BACK = {"today": 0, "week": 7, "month": 30, "year": 365}


class DateWindow(NamedTuple):
    """First and last day as ``YYYYMMDD``, both inside the window."""

    start: str
    end: str


def _ymd(day: date) -> str:
    return day.strftime("%Y%m%d")


def _is_total(preset: str | None) -> bool:
    return not preset or preset.lower() == "total"


def date_window(
    preset: str | None = None,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DateWindow | None:
    """Window of a preset, of one given day (that day and the next) or of custom ISO bounds, which come first.

    ``None`` means no filter: no preset, ``total``, or a text that is no date.
    """
    if start and end:
        return DateWindow(start.replace("-", ""), end.replace("-", ""))
    if _is_total(preset):
        return None
    today = as_of or date.today()
    back = DAYS_BACK.get(preset.lower())
    if back is not None:
        return DateWindow(_ymd(today - timedelta(days=back)), _ymd(today))
    try:
        day = date_parser.parse(preset, default=datetime.combine(today, time())).date()
        return DateWindow(_ymd(day), _ymd(day + timedelta(days=1)))
    except (ValueError, OverflowError):
        return None


def created_from(start: str) -> Column:
    """Normalised creation date at or after ``start``."""
    month = F.col("creation_month")
    return ((month >= start[:6]) | (month == OTHER_MONTH)) & (F.col("creation_ymd") >= start)


def created_to(end: str) -> Column:
    """Normalised creation date at or before ``end``."""
    month = F.col("creation_month")
    return ((month <= end[:6]) | (month == OTHER_MONTH)) & (F.col("creation_ymd") <= end)


def in_window(window: DateWindow | None) -> Column:
    if window is None:
        return F.lit(True)
    return created_from(window.start) & created_to(window.end)


def calendar_range(
    kind: str | None,
    as_of: date | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
) -> tuple[date, date]:
    """First and last day of a calendar range; an unknown kind is today."""
    today = as_of or date.today()
    if kind == "yesterday":
        return today - timedelta(days=1), today - timedelta(days=1)
    if kind == "this_week":
        return today - timedelta(days=today.weekday()), today
    if kind == "this_month":
        return today.replace(day=1), today
    if kind == "custom":
        return _as_day(start), _as_day(end)
    return today, today


def _as_day(value: date | str) -> date:
    return date_parser.parse(value).date() if isinstance(value, str) else value


def id_window(df: DataFrame, n: int) -> DataFrame:
    """Rows whose id is within ``n`` of the largest id: at most ``n`` rows, fewer where ids have gaps."""
    # The difference is taken inside the subquery, so that its result is a plain bound for the parquet filter.
    return df.where(F.col("id") > df.agg(F.max("id") - F.lit(n)).scalar())


def latest_n(df: DataFrame, n: int, counts: DataFrame | None = None) -> DataFrame:
    """Exactly the ``n`` rows with the largest ids, or all rows when there are fewer; unsorted and spread over the tasks.

    ``counts`` are the stored counts of exactly these rows; without them the rows are counted in the same plan.
    """
    return newest_rows(df, n, counts)
