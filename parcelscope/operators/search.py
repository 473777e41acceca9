"""Full-text search: words are ANDed, ``"a phrase"`` keeps its order, ``or`` separates alternatives, ``-`` excludes.

A search is either a column expression over the text (one scan, no shuffle) or a lookup in an inverted index, which
reads only the postings of the words asked for.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spaced_words, tokens

SEARCH_COLUMNS = (
    "number_shipment",
    "shipper_name",
    "consignee_name",
    "shipper_city",
    "consignee_city",
    "shipper_phone",
    "consignee_phone",
    "shipment_reference_number",
    "shipment_description",
)

BUCKETS = 64
KEYS_PER_FILE = 1 << 16

_PIECES = re.compile(r'(-*)(?:"([^"]*)"?|([^\s"]+))')


class Term(NamedTuple):
    """Words that follow each other; one word is a phrase of length one."""

    words: tuple[str, ...]
    excluded: bool


def words_of(text: str) -> tuple[str, ...]:
    """The words of a short text, by the same rule as :func:`parcelscope.functions.tokens`."""
    return tuple("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split())


def parse_search(text: str) -> list[list[Term]]:
    """Alternatives, each a list of terms that must all hold. ``or`` needs a term on both sides, else it is a word."""
    groups: list[list[Term]] = [[]]
    pieces = list(_PIECES.finditer(text))
    after_term = False
    for at, piece in enumerate(pieces):
        minus, phrase, word = piece.groups()
        if not minus and word and word.lower() == "or" and after_term and at + 1 < len(pieces):
            groups.append([])
            after_term = False
            continue
        found = words_of(phrase if word is None else word)
        after_term = True
        if found:
            groups[-1].append(Term(found, len(minus) % 2 == 1))
    return [group for group in groups if group]


def _either(groups: list[list[Term]], holds) -> Column:
    """The formula of a parsed search, given the column that says whether a phrase occurs."""
    each = [
        reduce(and_, [~holds(term.words) if term.excluded else holds(term.words) for term in group])
        for group in groups
    ]
    return reduce(or_, each, F.lit(False))


def search_text(*columns: str) -> Column:
    return F.concat_ws(" ", *(columns or SEARCH_COLUMNS))


def matches_search(text: Column, query: str) -> Column:
    """Whether a text satisfies a search; a search without any word matches nothing."""
    groups = parse_search(query)
    # Bound as the only element of an array, the text is cut into words once per row and not once per term.
    return F.exists(F.array(spaced_words(text)), lambda row: _either(groups, lambda words: row.contains(f" {' '.join(words)} ")))


def build_index(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """Postings ``(token, key, pos)`` of the joined columns."""
    return df.select(key, F.posexplode(tokens(search_text(*columns))).alias("pos", "token")).select("token", key, "pos")


def bucket_of(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str, tasks: int, key: str = "id", mode: str = "error") -> None:
    """Stores postings by bucket of the token and range of keys, so a search opens few files and a frequent token fills many.

    Where a posting goes follows from itself. Texts that are not yet cut into words are stored by :func:`store_index`.
    """
    placed = index.withColumn("bucket", bucket_of(F.col("token"))).repartition(tasks, "bucket", F.expr(f"{key} div {KEYS_PER_FILE}"))
    _write(placed, path, key, mode)


def store_index(df: DataFrame, path: str, tasks: int, *columns: str, key: str = "id", mode: str = "error") -> None:
    """Cuts the joined columns into words and stores their postings by bucket of the token, like :func:`write_index`.

    The texts move, not the postings, which are many times larger: a task gets whole texts by key and text, so neither
    a frequent token nor a frequent key fills one task.
    """
    texts = df.select(key, search_text(*columns).alias("_text")).repartition(tasks, key, "_text")
    index = build_index(texts, "_text", key=key)
    _write(index.withColumn("bucket", bucket_of(F.col("token"))), path, key, mode)


def _write(placed: DataFrame, path: str, key: str, mode: str) -> None:
    sorted_rows = placed.sortWithinPartitions("bucket", "token", key, "pos")
    sorted_rows.write.mode(mode).partitionBy("bucket").parquet(path)


def search_index(index: DataFrame, query: str, universe: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Keys that satisfy a search.

    Every posting votes for the place where its phrase would begin; a phrase occurs where all its words voted. Votes
    combine on the map side. A search with an alternative of excluded words only also needs the ``universe`` of keys.
    """
    groups = parse_search(query)
    phrases = list(dict.fromkeys(term.words for group in groups for term in group))
    if not phrases:
        return index.select(key).limit(0)
    slot_of = {words: slot for slot, words in enumerate(phrases)}
    uses: dict[str, list[tuple[int, int]]] = {}
    for words, slot in slot_of.items():
        for offset, word in enumerate(words):
            uses.setdefault(word, []).append((slot, offset))
    length = F.element_at(F.array(*[F.lit(len(words)) for words in phrases]), F.col("slot") + 1)
    roles = F.create_map(
        *[
            part
            for word, places in uses.items()
            for part in (
                F.lit(word),
                F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(o).alias("offset")) for s, o in places]),
            )
        ]
    )
    asked = F.col("token").isin(*uses)
    if "bucket" in index.columns:
        asked &= F.col("bucket").isin(sorted({zlib.crc32(word.encode()) % BUCKETS for word in uses}))
    votes = (
        index.where(asked)
        .select(key, "pos", F.explode(F.element_at(roles, F.col("token"))).alias("role"))
        .select(key, F.col("role.slot").alias("slot"), (F.col("pos") - F.col("role.offset")).alias("start"))
        .withColumn("start", F.when(length > 1, F.col("start")).otherwise(0))
    )
    places = votes.groupBy(key, "slot", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= length)
    hits = places.groupBy(key).agg(
        *[F.bool_or(F.col("slot") == slot).alias(f"has_{slot}") for slot in slot_of.values()]
    )
    if any(all(term.excluded for term in group) for group in groups):
        if universe is None:
            raise ValueError("a search for excluded words only needs the universe of keys")
        hits = universe.select(key).join(hits, key, "left")
    has = lambda words: F.coalesce(F.col(f"has_{slot_of[words]}"), F.lit(False))
    return hits.where(_either(groups, has)).select(key)
