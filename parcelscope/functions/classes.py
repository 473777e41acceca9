"""Classes of phones, references and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class labels with the pattern each stands for, tried in this order. ``\z`` ends the text; a plain
# ``$`` would also accept a closing line break.
PHONE_TYPES = (
    ("Saudi Mobile (05)", r"^05[0-9]{8}\z"),
    ("Business (9xx)", r"^9[0-9]{8,10}\z"),
    ("Toll-Free (800x)", r"^8[0-9]{9}\z"),
)
REFERENCE_TYPES = (
    ("SAL Pattern", r"^SAL[0-9]+\z"),
    ("Numbers Only", r"^[0-9]+\z"),
    ("Numbers with Dash", r"^[0-9]+-[0-9]+\z"),
)
SAL_PATTERN = REFERENCE_TYPES[0][1]

# Weight bands with the exact texts each holds, and the upper bound in kilograms.
WEIGHT_BANDS = (
    ("0-0.10 Kg", ("0.10 Kg",), 0.10),
    ("0.11-0.50 Kg", ("0.20 Kg", "0.30 Kg", "0.50 Kg"), 0.50),
    ("0.51-1.50 Kg", ("1.00 Kg", "1.50 Kg"), 1.50),
    ("1.51-3.00 Kg", ("2.00 Kg", "3.00 Kg"), 3.00),
)
HEAVIEST_BAND = "3.00+ Kg"
OTHER = "Other"


def _first_match(text: Column, classes) -> Column:
    (label, pattern), *rest = classes
    found = F.when(text.rlike(pattern), label)
    for label, pattern in rest:
        found = found.when(text.rlike(pattern), label)
    return found.otherwise(OTHER)


def phone_type(phone: Column) -> Column:
    return _first_match(phone, PHONE_TYPES)


def reference_type(reference: Column) -> Column:
    return _first_match(reference, REFERENCE_TYPES)


def weight_band(text: Column) -> Column:
    """Band by exact weight text; every other text, also the empty one, is in the heaviest band."""
    (label, texts, _), *rest = WEIGHT_BANDS
    band = F.when(text.isin(*texts), label)
    for label, texts, _ in rest:
        band = band.when(text.isin(*texts), label)
    return band.otherwise(HEAVIEST_BAND)


def weight_band_kg(weight: Column) -> Column:
    """Band of a parsed weight; NULL stays NULL."""
    (label, _, upper), *rest = WEIGHT_BANDS
    band = F.when(weight.isNull(), None).when(weight <= upper, label)
    for label, _, upper in rest:
        band = band.when(weight <= upper, label)
    return band.otherwise(HEAVIEST_BAND)
