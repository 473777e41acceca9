from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelscope import functions as N


def test_creation_ymd(column):
    texts = ["05-Oct-25", "05-OCT-25", "31-Feb-25", "20251005", "N/A", "", None, "05/Oct/25"]
    assert column(N.creation_ymd, texts) == ["20251005", None, "20250231", "20251005", "N/A", "", None, "05/Oct/25"]


def test_creation_ymd_strict_needs_nine_characters_only(column):
    texts = ["05-Oct-25", "05/Oct/25", "05-OCT-25", "20251005", "N/A", None]
    strict = column(lambda c: N.creation_ymd(c, strict=True), texts)
    assert strict == ["20251005", "20251005", None, None, None, None]


def test_creation_day_and_month(column):
    texts = ["20251005", "20250231", "N/A", None, "20251305", "2025100"]
    assert [str(day) for day in column(N.creation_day, texts)] == ["2025-10-05"] + ["None"] * 5
    assert column(N.creation_month, texts) == ["202510", "202502", "other", "other", "other", "202510"]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("0.50 Kg", "0.5"),
        ("Kg. 5", "0.5"),
        ("-5 Kg", "5"),
        ("1,5 Kg", "15"),
        (".", "0"),
        ("..", "0"),
        (" .5 ", "0.5"),
        ("5.", "5"),
        ("1e3", "13"),
        ("SAR 12.25", "12.25"),
        ("N/A", None),
        ("1.2.3", None),
        ("..5", None),
        ("   ", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_amount(column, text, number):
    assert column(N.parse_amount, [text]) == [None if number is None else Decimal(number)]


def test_phone_type(column):
    phones = ["0512345678", "920033385", "8001234567", None, "0512345678\n", "05123"]
    assert column(N.phone_type, phones) == [
        "Saudi Mobile (05)",
        "Business (9xx)",
        "Toll-Free (800x)",
        "Other",
        "Other",
        "Other",
    ]


def test_reference_type(column):
    references = ["SAL12", "12", "12-3", "sal12", None, "SAL12\n", "SAL"]
    assert column(N.reference_type, references) == [
        "SAL Pattern",
        "Numbers Only",
        "Numbers with Dash",
        "Other",
        "Other",
        "Other",
        "Other",
    ]


def test_weight_bands(column):
    texts = ["0.10 Kg", "0.30 Kg", "1.50 Kg", "3.00 Kg", "0.15 Kg", ""]
    bands = ["0-0.10 Kg", "0.11-0.50 Kg", "0.51-1.50 Kg", "1.51-3.00 Kg", "3.00+ Kg", "3.00+ Kg"]
    assert column(N.weight_band, texts) == bands
    assert column(lambda c: N.weight_band_kg(N.parse_amount(c)), texts) == [*bands[:4], "0.11-0.50 Kg", None]


def test_month_parts(column):
    texts = ["05-Oct-25", "x 05-Oct-25 y", "05-OCT-25", "20251005", "", None]
    assert column(N.dmy_month, texts) == ["Oct", "Oct", "OCT", None, None, None]
    assert column(N.dmy_year, texts) == ["25", "25", "25", None, None, None]
    assert column(N.month_label, texts) == ["10-2025", "10-2025", None, None, None, None]


def test_clean_text(column):
    texts = ["  a‏b 　\n", None, "‪‮", "\x1c\x0bx\x85", "a  b"]
    assert column(N.clean_text, texts) == ["ab", "", "", "x", "a  b"]


def test_presentation_forms(column):
    assert column(N.has_presentation_forms, ["ﺍ", "ﭐx", "ا", "abc"]) == [True, True, False, False]


def test_valid_utf8_drops_bad_bytes_and_keeps_the_replacement_character(column):
    def broken(c):
        return N.valid_utf8(F.when(c == "bad", F.lit(bytearray(b"a\xffb")).cast("string")).otherwise(c))

    assert column(broken, ["bad", "a�b"]) == ["ab", "a�b"]


def test_tokens(column):
    assert column(N.tokens, ["Ab-12, cÉ x", "", "--"]) == [["ab", "12", "cé", "x"], [], []]


def test_pack_and_unpack(spark):
    df = spark.range(1).select(
        N.pack_params(F.create_map(F.lit("a"), F.lit("1")), F.array(F.lit("id"))).alias("packed")
    )
    found = df.select(N.unpack_params(F.col("packed")).alias("p")).first()["p"]
    assert found["filters"] == {"a": "1"}
    assert found["columns"] == ["id"]
    assert found["report_type"] == "custom"
    assert found["is_public"] is False
    assert found["chart_config"] == {}
