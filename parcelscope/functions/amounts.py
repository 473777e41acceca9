"""Numbers written as text: weights, cash on delivery and box counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_TYPE = "decimal(18,4)"


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def parse_amount(text: Column) -> Column:
    """Number made of the digits and points of a text: ``0.50 Kg`` -> 0.5, ``1,5 Kg`` -> 15, ``.`` -> 0.

    Signs, separators and exponents are dropped with the other letters. Text without a digit or point, and text with
    more than one point, is NULL.
    """
    kept = F.regexp_replace(text, "[^0-9.]", "")
    # The leading zero makes ".5" and a lone point readable and changes no other number.
    number = F.concat(F.lit("0"), F.regexp_replace(kept, r"[.]\z", ""))
    return F.when(kept != "", number.try_cast(AMOUNT_TYPE))


def boxes_int(text: Column) -> Column:
    return text.try_cast("int")
