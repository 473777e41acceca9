"""Column functions: each takes and returns a ``Column`` and stays inside generated JVM code."""

from .amounts import boxes_int, has_digit, parse_amount
from .classes import phone_type, reference_type, weight_band, weight_band_kg
from .dates import (
    creation_day,
    creation_month,
    creation_ymd,
    dmy_month,
    dmy_year,
    is_dmy,
    iso_to_ymd,
    month_label,
    month_number,
    to_dmy,
)
from .packing import pack_params, unpack_params
from .text import clean_text, has_presentation_forms, spaced_words, tokens, valid_utf8

__all__ = [
    "boxes_int",
    "clean_text",
    "creation_day",
    "creation_month",
    "creation_ymd",
    "dmy_month",
    "dmy_year",
    "has_digit",
    "has_presentation_forms",
    "is_dmy",
    "iso_to_ymd",
    "month_label",
    "month_number",
    "pack_params",
    "parse_amount",
    "phone_type",
    "reference_type",
    "spaced_words",
    "to_dmy",
    "tokens",
    "unpack_params",
    "valid_utf8",
    "weight_band",
    "weight_band_kg",
]
