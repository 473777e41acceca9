"""Creation dates arrive as ``DD-Mon-YY``, ``YYYYMMDD`` or junk text; these columns make them comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as written in the data, January first.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

OTHER_MONTH = "other"
"""Partition value of rows whose creation date names no month."""

_DMY = r"\d{2}-([A-Za-z]{3})-(\d{2})"


def month_number(name: Column) -> Column:
    """``Jan`` -> ``01`` ... ``Dec`` -> ``12``; any other text, also in another case, is NULL."""
    # A lookup, because a chain of comparisons would compute ``name`` anew for each month.
    numbers = [F.lit(part) for at, month in enumerate(MONTHS, start=1) for part in (month, f"{at:02d}")]
    return F.try_element_at(F.create_map(*numbers), name)


def is_dmy(text: Column) -> Column:
    """Looks like ``DD-Mon-YY``: nine characters with dashes third and seventh."""
    return text.like("__-___-__")


def creation_ymd(text: Column, strict: bool = False) -> Column:
    """``DD-Mon-YY`` as ``YYYYMMDD`` text.

    Other text passes through unchanged, and a well-formed date with an unknown month is NULL. With ``strict`` any
    nine characters count as a date and everything else is NULL.
    """
    turned = F.concat(
        F.lit("20"), F.substring(text, 8, 2), month_number(F.substring(text, 4, 3)), F.substring(text, 1, 2)
    )
    if strict:
        return F.when(F.length(text) == 9, turned)
    return F.when(is_dmy(text), turned).otherwise(text)


def creation_month(ymd: Column) -> Column:
    """Partition value ``YYYYMM`` of a normalised date; text that names no month of 20YY goes to ``other``."""
    return F.when(ymd.rlike(r"^20[0-9]{2}(0[1-9]|1[0-2])"), F.substring(ymd, 1, 6)).otherwise(OTHER_MONTH)


def creation_day(ymd: Column) -> Column:
    """Real date of a normalised date, NULL for junk and for days such as 31 February."""
    dashed = F.concat_ws("-", F.substring(ymd, 1, 4), F.substring(ymd, 5, 2), F.substring(ymd, 7, 2))
    return F.when(ymd.rlike(r"^[0-9]{8}\z"), dashed.try_cast("date"))


def iso_to_ymd(text: Column) -> Column:
    """``YYYY-MM-DD`` -> ``YYYYMMDD``."""
    return F.regexp_replace(text, "-", "")


def dmy_month(text: Column) -> Column:
    """Three-letter month found anywhere in the text, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, _DMY, 1), F.lit(""))


def dmy_year(text: Column) -> Column:
    """Two-digit year found anywhere in the text, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, _DMY, 2), F.lit(""))


def month_label(text: Column) -> Column:
    """``MM-20YY``; NULL when the text has no date or an unknown month."""
    return F.concat(month_number(dmy_month(text)), F.lit("-20"), dmy_year(text))


def to_dmy(day: Column) -> Column:
    """Date -> ``DD-Mon-YY`` text."""
    return F.date_format(day, "dd-MMM-yy")
