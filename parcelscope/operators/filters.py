"""Predicates over shipments. An empty value means that the filter is not set."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes_int
from .windows import created_from, created_to, date_window, in_window

# Parameter names of the advanced search, and the column each one looks into.
SUBSTRING_PARAMS = {
    "shipment_number": "number_shipment",
    "reference_number": "shipment_reference_number",
    "description": "shipment_description",
    "pdf_filename": "pdf_filename",
    "shipper_name": "shipper_name",
    "shipper_city": "shipper_city",
    "shipper_phone": "shipper_phone",
    "shipper_address": "shipper_address",
    "consignee_name": "consignee_name",
    "consignee_city": "consignee_city",
    "consignee_phone": "consignee_phone",
    "consignee_address": "consignee_address",
    "from_city": "shipper_city",
    "to_city": "consignee_city",
}
OTHER_PARAMS = (
    "id",
    "country_code",
    "number_of_boxes",
    "creation_date_from",
    "creation_date_to",
    "processing_date_from",
    "processing_date_to",
    "min_weight",
    "max_weight",
    "cod",
)
BUILT_QUERY_SUBSTRINGS = ("shipper_name", "shipper_city", "consignee_name", "consignee_city")


def checked(df: DataFrame, name: str) -> Column:
    """Column of ``df`` by name; a name it does not have is refused, so caller text never becomes an expression."""
    if name not in df.columns:
        raise ValueError(f"no such column: {name}")
    return F.col(f"`{name}`")


def project(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The named columns, or all of them when none is named."""
    names = list(columns or [])
    return df.select(*[checked(df, name) for name in names]) if names else df


def contains_like(column: Column, value: str, literal: bool = False) -> Column:
    """Case-sensitive substring. ``%`` and ``_`` in the value are wildcards unless ``literal``."""
    if literal:
        return column.contains(value)
    # A backslash before an ordinary character stands for that character; Spark would refuse it.
    pattern = re.sub(r"\\(.)", lambda pair: pair[0] if pair[1] in "%_\\" else pair[1], value, flags=re.DOTALL)
    return column.like(f"%{pattern}%")


def filter_by(df: DataFrame, column: str, value: str, literal: bool = False) -> DataFrame:
    return df.where(contains_like(checked(df, column).cast("string"), value, literal))


def present(column: Column, null_words: Iterable[str] = ()) -> Column:
    """Not NULL, not empty and none of the words that stand for a missing value."""
    return column.isNotNull() & ~column.isin("", *null_words)


def matches(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def number_or_none(value) -> Decimal | float | None:
    """A bound given as a number or text. It stays decimal, so that it reaches the parquet filter as it is."""
    try:
        number = float(value)
        return Decimal(str(value).strip()) if math.isfinite(number) else number
    except (TypeError, ValueError, ArithmeticError):
        return None


def weight_between(low=None, high=None) -> list[Column]:
    """Inclusive bounds on the parsed weight; a bound that is no number is ignored."""
    low, high = number_or_none(low), number_or_none(high)
    weight = F.col("weight_kg")
    bounds = [] if low is None else [weight >= low]
    return bounds if high is None else [*bounds, weight <= high]


def weight_above(low) -> Column:
    bound = number_or_none(low)
    if bound is None:
        raise ValueError(f"no number: {low!r}")
    return F.col("weight_kg") > bound


def cod_is(answer: str) -> Column | None:
    """``yes``: something is to be paid; ``no``: nothing, or no readable amount; any other answer is no filter."""
    amount = F.col("cod_amount")
    if answer.lower() == "yes":
        return amount > 0
    if answer.lower() == "no":
        return (amount == 0) | amount.isNull()
    return None


def processing_between(start: str | None = None, end: str | None = None) -> list[Column]:
    """Bounds on the processing date, compared as text."""
    at = F.col("processing_date")
    bounds = [at >= start] if start else []
    return [*bounds, at <= end] if end else bounds


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def search_conditions(**params) -> list[Column]:
    """Conditions of the advanced search, one for each parameter that is set."""
    unknown = set(params) - set(SUBSTRING_PARAMS) - set(OTHER_PARAMS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    given = {name: value for name, value in params.items() if value not in (None, "")}
    conditions = [
        contains_like(F.col(column), str(given[name])) for name, column in SUBSTRING_PARAMS.items() if name in given
    ]
    if "id" in given:
        conditions.append(F.col("id") == int(given["id"]))
    if "country_code" in given:
        conditions.append(F.col("country_code") == given["country_code"])
    if "number_of_boxes" in given:
        conditions.append(boxes_int(F.col("number_of_shipment_boxes")) == int(given["number_of_boxes"]))
    if "creation_date_from" in given:
        conditions.append(created_from(given["creation_date_from"].replace("-", "")))
    if "creation_date_to" in given:
        conditions.append(created_to(given["creation_date_to"].replace("-", "")))
    conditions += processing_between(given.get("processing_date_from"), given.get("processing_date_to"))
    conditions += weight_between(given.get("min_weight"), given.get("max_weight"))
    if "cod" in given and (paid := cod_is(given["cod"])) is not None:
        conditions.append(paid)
    return conditions


def build_query(
    df: DataFrame,
    filters: dict | None = None,
    columns: Iterable[str] | None = None,
    as_of=None,
    limit: int | None = None,
) -> DataFrame:
    """Rows that pass the filters of a stored report, newest first; keys it does not know are ignored."""
    filters = {name: value for name, value in (filters or {}).items() if value}
    conditions = [in_window(date_window(filters.get("date_filter"), as_of))]
    conditions += [
        contains_like(F.col(name), str(filters[name])) for name in BUILT_QUERY_SUBSTRINGS if name in filters
    ]
    conditions += weight_between(filters.get("min_weight"), filters.get("max_weight"))
    rows = df.where(all_of(conditions)).orderBy(F.desc("id"))
    return project(rows if limit is None else rows.limit(limit), columns)


def active(df: DataFrame) -> DataFrame:
    return df.where("is_active")
