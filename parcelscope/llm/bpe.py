"""BPE encoding and decoding of whole texts, long ones as a tree of halves.

A text of up to ``leaf`` characters is encoded at once. A longer one is cut into leaves that different tasks encode,
and neighbours are joined pairwise up a tree. Around a join the two encodings may differ from that of the whole text,
so a window is encoded anew that begins at a piece of the left side and reaches into the right side. It grows on the
side on which it doesn't yet agree: on the left its first piece must be the left side's, on the right one of its later
pieces must begin where a piece of the right side begins. A piece (the tokenizer's split before merging) depends on the
text from its beginning to ``LOOK`` characters behind its end, never on what is before it. So from a place where both
begin a piece they go on alike, and the joined result is exactly the encoding of the whole. If they never agree, the
window reaches the end of the right side and is exact for that reason.

Pieces are encoded with the tokenizer's own ranks; short ones are kept in a cache of bounded memory. A text with a special token's string, or with
characters outside ``SAFE`` (where the splitting pattern is tested against the library), is given to the library whole.

Defined results: a null or empty text has no tokens; a null id stays null; rows that repeat give rows that repeat; only
the named columns are read. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .texts import chunks

TOKENIZER = "byte_bpe_50k.json"
LEAF = 1 << 15
LOOK = 4
SAFE = re.compile(r"[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
# The letters, numbers and white space among the characters of SAFE, in the tokenizer's pattern.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = "\t-\r\x20\x85\xa0"
PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LETTERS}{NUMBERS}{SPACES}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(others)}


class Coder:
    """Encodes and decodes with one tokenizer file."""

    FULL = 1 << 17
    SHORT = 64

    def __init__(self, name: str):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        of_char = byte_table()
        vocabulary = self.library.get_vocab()
        # in a byte-level vocabulary ids follow the order of merges, so they are ranks
        self.ranked = tiktoken.Encoding(
            name,
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={
                bytes(map(of_char.__getitem__, token)): at
                for token, at in vocabulary.items()
                if token not in self.special
            },
            special_tokens={token: vocabulary[token] for token in self.special},
        )
        self.known: dict[str, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or SAFE.fullmatch(text) is not None) and not any(x in text for x in self.special)

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        new = [piece for piece in set(pieces) if piece not in known]
        if len(known) + len(new) > self.FULL:
            known.clear()
            new = list(set(pieces))
        long: dict[str, bytes] = {}  # not kept, so that the cache is bounded in memory, not only in entries
        for piece in new:
            place = known if len(piece) <= self.SHORT else long
            place[piece] = np.array(self.ranked.encode_ordinary(piece), "<u4").tobytes()
        if long:
            return [long[piece] if piece in long else known[piece] for piece in pieces]
        return [known[piece] for piece in pieces]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit numbers."""
        if not self.is_plain(text):
            return self.by_library(text)
        return b"".join(self.of_pieces(PIECE.findall(text)))

    def decode(self, ids: bytes) -> str:
        return self.ranked.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(name: str) -> Coder:
    return Coder(name)


class Encoded:
    """A stretch of text, where its pieces begin, and the ids of each piece."""

    def __init__(self, text: str, starts: list[int], ids: list[bytes]):
        self.text, self.starts, self.ids = text, starts, ids

    @classmethod
    def of(cls, text: str, code: Coder) -> Encoded:
        pieces = PIECE.findall(text)
        starts = [0, *np.cumsum([len(piece) for piece in pieces]).tolist()][:-1]
        return cls(text, starts, code.of_pieces(pieces))


def join(left: Encoded, right: Encoded, code: Coder) -> Encoded:
    """The encoding of both texts one after the other."""
    if not left.text or not right.text:
        return right if not left.text else left
    edge, back, reach = len(left.text), 2, 16
    begins = set(right.starts)
    while True:
        first = max(0, len(left.starts) - back)
        start = left.starts[first]
        window = Encoded.of(left.text[start:] + right.text[:reach], code)
        end = start + len(window.text)
        places = [start + at for at in window.starts]
        whole = reach >= len(right.text)
        # the window's first piece is the left side's own, unless the left side's end has a part in it
        agrees = first == 0 or (
            len(places) > 1 and places[1] == left.starts[first + 1] and places[1] + LOOK <= edge
        )
        if not agrees:
            back *= 2
            continue
        for at, place in enumerate(places):
            sure = at + 1 < len(places) and place + LOOK <= end
            if place >= edge and place - edge in begins and sure:
                cut = right.starts.index(place - edge)
                rest, more = [edge + x for x in right.starts[cut:]], right.ids[cut:]
                return Encoded(
                    left.text + right.text,
                    left.starts[:first] + places[:at] + rest,
                    left.ids[:first] + window.ids[:at] + more,
                )
        if whole:
            return Encoded(left.text + right.text, left.starts[:first] + places, left.ids[:first] + window.ids)
        reach *= 2


def encode_tree(parts: list[Encoded], code: Coder) -> Encoded:
    """Joins neighbours pairwise until one is left."""
    while len(parts) > 1:
        joined = [join(parts[at], parts[at + 1], code) for at in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0]


def encoded_leaves(batch: pd.DataFrame, code: Coder) -> Iterator[pd.DataFrame]:
    """The rows of ``batch`` with the places and ids of their pieces, a few at a time: pieces take some ten times a text's memory."""
    texts = batch["text"].tolist()
    for part in chunks(texts):
        done = [Encoded.of(text, code) if code.is_plain(text) else None for text in texts[part]]
        yield batch.iloc[part].assign(
            starts=[np.array(x.starts, "<u4").tobytes() if x else None for x in done],
            lengths=[np.array([len(y) for y in x.ids], "<u4").tobytes() if x else None for x in done],
            ids=[b"".join(x.ids) if x else None for x in done],
        )


def _result(ids: bytes, code: Coder, with_ids: bool, with_text: bool) -> tuple:
    text = code.decode(ids)
    return (
        len(ids) // 4,
        hashlib.sha256(ids).hexdigest(),
        hashlib.sha256(text.encode()).hexdigest(),
        ids if with_ids else None,
        text if with_text else None,
    )


_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
_TYPES = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def bpe_round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    leaf: int = LEAF,
    with_ids: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """Per row the number of tokens and digests of ids and decoded text; on demand the ids (32-bit) and that text."""
    id_type = docs.select(id_col).dtypes[0][1]
    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > leaf

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(tokenizer)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for part in chunks(texts):
                rows = [_result(code.encode(text), code, with_ids, with_text) for text in texts[part]]
                out = pd.DataFrame(rows, columns=_NAMES)
                out.insert(0, "doc_id", ids[part])
                yield out

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                at = range(0, len(text), leaf)
                yield pd.DataFrame({"row": row, "doc_id": doc_id, "part": at, "text": [text[x : x + leaf] for x in at]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(tokenizer)
        for batch in batches:
            yield from encoded_leaves(batch, code)

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        code = coder(tokenizer)
        group = group.sort_values("part")
        text = "".join(group["text"])
        if code.is_plain(text):
            parts = []
            for part, starts, lengths, ids in zip(group["text"], group["starts"], group["lengths"], group["ids"]):
                ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
                pieces = [ids[a:b] for a, b in zip([0, *ends], ends)]
                parts.append(Encoded(part, np.frombuffer(starts, "<u4").tolist(), pieces))
            ids = b"".join(encode_tree(parts, code).ids)
        else:
            ids = code.by_library(text)
        out = pd.DataFrame([_result(ids, code, with_ids, with_text)], columns=_NAMES)
        out.insert(0, "doc_id", group["doc_id"].iloc[0])
        return out

    out_type = f"doc_id string, {_TYPES}"
    part_type = "row long, doc_id string, part long, text string"
    parts = read.where(is_long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = parts.mapInPandas(cut, part_type).repartition("row", "part")
    encoded = parts.mapInPandas(leaves, f"{part_type}, starts binary, lengths binary, ids binary")
    found = (
        read.where(~is_long)
        .mapInPandas(short, out_type)
        .unionByName(encoded.groupBy("row").applyInPandas(tree, out_type))
        .withColumn("doc_id", F.col("doc_id").cast(id_type))
    )
    unwanted = [name for name, wanted in (("ids", with_ids), ("decoded", with_text)) if not wanted]
    return found.drop(*unwanted)
