"""Text clean-up and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bidirectional control marks that are removed.
BIDI_MARKS = "\u200f\u200e\u202a\u202b\u202c\u202d\u202e"

# White space, first that of ASCII, then the rest of Unicode; plain trim() removes only U+0020.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
WIDE_SPACE = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The Arabic presentation form blocks.
_PRESENTATION_FORMS = r"[\uFB50-\uFDFF\uFE70-\uFEFF]"

_NOT_IN_WORDS = r"[^\p{L}\p{N}]+"


def valid_utf8(text: Column) -> Column:
    """Text without the bytes that are no valid UTF-8.

    The repair puts U+FFFD where bytes are broken. One that was there before is written in another way meanwhile.
    """
    kept = F.replace(F.replace(text, F.lit("\ufdd0"), F.lit("\ufdd0a")), F.lit("\ufffd"), F.lit("\ufdd0b"))
    repaired = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(repaired, F.lit("\ufdd0b"), F.lit("\ufffd")), F.lit("\ufdd0a"), F.lit("\ufdd0"))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def clean_text(text: Column) -> Column:
    """NULL as '', invalid bytes removed, white space cut off both ends, bidirectional marks removed."""
    valid = valid_utf8(F.coalesce(text, F.lit("")))
    # Text without a multi-byte character holds no mark and no wide space, and most text is of that kind.
    ascii_only = F.octet_length(valid) == F.char_length(valid)
    wide = F.translate(F.btrim(valid, F.lit(ASCII_SPACE + WIDE_SPACE)), BIDI_MARKS, "")
    return F.when(ascii_only, F.btrim(valid, F.lit(ASCII_SPACE))).otherwise(wide)


def has_presentation_forms(text: Column) -> Column:
    return text.rlike(_PRESENTATION_FORMS)


def spaced_words(text: Column) -> Column:
    """The tokens of a text, each between blanks, so that a phrase is found by ``contains``."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _NOT_IN_WORDS, " "), F.lit(" "))


def tokens(text: Column) -> Column:
    """Lower-case words of a text in order: runs of letters and digits, no stemming and no stop words."""
    return F.array_remove(F.split(F.lower(text), _NOT_IN_WORDS), "")
