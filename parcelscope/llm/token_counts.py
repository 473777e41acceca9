"""Tokens of whole texts under a sentencepiece vocabulary, by a broadcast table in front of each worker's cache.

The vocabulary never joins a space to what is before it, so the encoding of a text is that of its pre-tokens one after
the other: runs of spaces with the characters behind them, after one space is put in front of the text (the library's
own prefix). A pre-token's number of tokens is looked up in two tiers, both on the side of the map:

1. a table of frequent pre-tokens that the driver encodes once and broadcasts. It comes from one pass over all texts in which every task
   keeps a summary of its most frequent pre-tokens; summaries, not pre-tokens, are merged in groups of ``FAN`` until
   one is left. Summary and table have at most ``TABLE`` entries of up to ``LONGEST`` characters, some 4 MB;
2. a cache in each worker for all others, bounded by entries and, beyond one chunk, by the same length. The misses of a chunk of texts are encoded in one call.

The table decides speed only: a pre-token missing from both tiers is encoded by the library, so the counts are exact
whatever the summaries hold. No pre-token is shuffled.

Defined results: a null or empty text has no bytes and no tokens; a null id stays null; rows that repeat give rows that
repeat; an empty table gives no rows; only the named columns are read, so clashing names don't matter. Strings of
special tokens are ordinary text, as in the library.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .texts import chunks

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE = 1 << 15
LONGEST = 32
FAN = 32
PRE_TOKEN = re.compile(" *[^ ]+| +")
SPACE_MARK = "▁"  # stands for a space in the vocabulary, also where a text has it


def pre_tokens(text: str) -> list[str]:
    """Independent parts of a text; together they are the text with one space in front."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " ")) if text else []


@lru_cache(maxsize=2)
def library(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


@lru_cache(maxsize=2)
def begins(model: str) -> np.ndarray:
    """Which ids are pieces with a space in front, that is, begin a pre-token."""
    read = library(model)
    return np.array([read.id_to_piece(at).startswith(SPACE_MARK) for at in range(read.get_piece_size())])


def encoded_lengths(tokens: list[str], model: str = MODEL) -> list[int]:
    """Tokens of each pre-token. Those of one space and more are encoded in one call and told apart by their first pieces.

    The library puts the first space back itself, but not in front of nothing.
    """
    found, plain = [0] * len(tokens), []
    for at, token in enumerate(tokens):
        if len(token) == 1:
            found[at] = 1
        elif token[1] == " ":
            found[at] = len(library(model).encode(token[1:], num_threads=1))
        else:
            plain.append(at)
    if plain:
        ids = library(model).encode("".join([tokens[at] for at in plain])[1:], num_threads=1)
        starts = np.flatnonzero(begins(model)[ids])
        for at, n in zip(plain, np.diff(starts, append=len(ids)).tolist()):
            found[at] = n
    return found


class Lengths(dict):
    """Both tiers in one look-up: the broadcast table, and what this worker has met; emptied down to the table when full."""

    FULL = 1 << 18

    def __init__(self, frequent: dict[str, int], model: str = MODEL):
        super().__init__(frequent)
        self.frequent, self.model = frequent, model

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, chunk by chunk so that memory doesn't follow the batch."""
        found = []
        for part in chunks(texts):
            if len(self) > self.FULL:
                self.clear()
                self.update(self.frequent)
            split = [pre_tokens(text) for text in texts[part]]
            misses = list({token for tokens in split for token in tokens if token not in self})
            self.update(zip(misses, encoded_lengths(misses, self.model)))
            found += [sum(map(self.__getitem__, tokens)) for tokens in split]
            for token in misses:
                if len(token) > LONGEST:
                    del self[token]
        return found


def most_frequent(counts: Counter, size: int) -> dict[str, int]:
    """The ``size`` most frequent of those with up to ``LONGEST`` characters."""
    return dict(Counter({token: n for token, n in counts.items() if len(token) <= LONGEST}).most_common(size))


_SUMMARY = "part long, tokens array<string>, counts array<long>"


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", size: int = TABLE) -> list[str]:
    """Pre-tokens that are frequent in all texts, at most ``size``."""

    def packed(part: int, counts: Counter) -> pd.DataFrame:
        kept = most_frequent(counts, size)
        return pd.DataFrame({"part": [part], "tokens": [list(kept)], "counts": [list(kept.values())]})

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = Counter(), None
        for batch in batches:
            if part is None and len(batch):
                part = batch.column("part")[0].as_py()
            for text in batch.column("text"):
                counts.update(pre_tokens(text.as_py()))
                if len(counts) > 8 * size:
                    counts = Counter(most_frequent(counts, size))
        if part is not None:
            yield pa.RecordBatch.from_pandas(packed(part, counts), schema=schema)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        counts = Counter()
        for tokens, times in zip(group["tokens"], group["counts"]):
            for token, n in zip(tokens, times):
                counts[token] += int(n)
        return packed(int(group["part"].iloc[0]) // FAN, counts)

    schema = pa.schema([("part", pa.int64()), ("tokens", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    read = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(text_col).alias("text"))
    found = stored(read.where("text <> ''").mapInArrow(summary, _SUMMARY), "pre_token_summaries")
    last = found.agg(F.max("part")).first()[0] or 0
    while last:  # FAN summaries become one, so no task holds more than FAN of them
        found = found.groupBy((F.col("part") / FAN).cast("long")).applyInPandas(merge, _SUMMARY)
        last //= FAN
    rows = found.select("tokens").collect()  # one row of at most `size` entries, none without texts
    return list(rows[0]["tokens"]) if rows else []


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    limit: int = LIMIT,
    table: int = TABLE,
) -> DataFrame:
    """Per row its id, bytes, tokens, and whether these are more than ``limit``."""
    spark = docs.sparkSession
    tokens = frequent_pre_tokens(docs, text_col, table)
    frequent = dict(zip(tokens, encoded_lengths(tokens, model)))
    shared = spark.sparkContext.broadcast(frequent)  # at most `table` short strings
    id_type = docs.select(id_col).dtypes[0][1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value, model)
        for batch in batches:
            n = pa.array(lengths.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = read.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
