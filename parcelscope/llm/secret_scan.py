"""Secret scans: three base patterns, and random strings found by their token efficiency.

The base spans are those of the patterns, leftmost and without overlap per kind: a name such as ``password`` with an
assigned value of 6 characters or more (the span is the whole match), ``AKIA`` keys of 20 characters or more, and runs
of 24 or more hex digits.

The method looks at every run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a letter. A tokenizer's vocabulary
holds what people write, so such text has many characters per token; random strings fall apart into short tokens. A run
with fewer than ``max_ratio`` characters per token is a span of kind ``random``, unless it is a digest of a known length
or an identifier that isn't secret: a UUID, a number, a date or time. A run whose parts between ``-_/+=`` are each letters
only or digits only may be a name or a version; it is random if its longer words, ``MIN_LETTERS`` or more together, have
fewer than ``LETTERS_RATIO`` characters per token.
A run that isn't random as a whole is cut at its separators: neighbouring parts that each fall apart, 16 characters or
more together, are tested in the same way, so words joined to a key don't hide it.
A random span inside a base span is not given again.

Defined results: a null text has no spans; a null id stays null; rows that repeat give rows that repeat; only the named
columns are read. Places are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RATIO = 2.0
LETTERS_RATIO = 1.7
MIN_RUN = 16
MIN_LETTERS = 12
SHORT = 4
KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either_case(x) for x in ("password", "passwd", "secret", "token")] + [_either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
PART = re.compile(r"[A-Za-z0-9]+")
_NAME_HINT = re.compile(r"(?i:passw|secret|token|api_?key)")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_UUID_INSIDE = re.compile(rf"(?<![0-9A-Za-z]){_UUID.pattern}(?![0-9A-Za-z])")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_TIME = re.compile(r"\d{4}-?\d\d-?\d\dT[\dZ+-]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


@lru_cache(maxsize=4)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests and identifiers, which are random or numeric but no secrets."""
    return bool(_UUID.fullmatch(run) or _TIME.fullmatch(run) or len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run))


def characters_per_token(run: str, vocabulary: str = VOCABULARY) -> float:
    return len(run) / len(encoding(vocabulary).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base patterns, sorted."""
    found = []
    if _NAME_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> bool:
    parts = PART.findall(run)
    if is_known(run) or all(map(str.isdigit, parts)):
        return False
    if not all(part.isalpha() or part.isdigit() for part in parts):
        return characters_per_token(run, vocabulary) < max_ratio
    words = [part for part in parts if part.isalpha() and len(part) >= SHORT]
    letters = sum(map(len, words))
    if letters < MIN_LETTERS:
        return False
    return letters < min(LETTERS_RATIO, max_ratio) * sum(len(encoding(vocabulary).encode_ordinary(word)) for word in words)


def _falls_apart(part: str, vocabulary: str, max_ratio: float) -> bool:
    if part.isdigit() or is_known(part):
        return False
    return characters_per_token(part, vocabulary) < (min(LETTERS_RATIO, max_ratio) if part.isalpha() else max_ratio)


def _stretches(run: str, vocabulary: str, max_ratio: float) -> Iterator[tuple[int, int]]:
    """Places of neighbouring parts that each fall apart; parts too short to tell go with the ones before them."""
    known = [m.span() for m in _UUID_INSIDE.finditer(run)]
    start = short = end = None
    for m in PART.finditer(run):
        inside = any(a <= m.start() < b for a, b in known)
        if not inside and len(m[0]) < SHORT:
            if start is not None:
                end = m.end()
            elif short is None:
                short = m.start()
        elif not inside and _falls_apart(m[0], vocabulary, max_ratio):
            if start is None:  # base64 has + in the middle, names don't
                start = short if short is not None and run[m.start() - 1] == "+" else m.start()
            end = m.end()
        else:
            if start is not None:
                yield start, end
            start = short = end = None
    if start is not None:
        yield start, len(run) if not run[end:].strip("=") else end


def random_spans(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if is_random(run, vocabulary, max_ratio):
            found.append((m.start(), 3, m.end()))
            continue
        for start, end in _stretches(run, vocabulary, max_ratio):
            if end - start >= MIN_RUN and is_random(run[start:end], vocabulary, max_ratio):
                found.append((m.start() + start, 3, m.start() + end))
    return found


def all_spans(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO):
    """Base spans, and base and random spans together, both in order."""
    base = base_spans(text)
    more = [x for x in random_spans(text, vocabulary, max_ratio) if not any(a <= x[0] and x[2] <= b for a, _, b in base)]
    return base, sorted(base + more)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans, mark: str = "<SECRET>") -> str:
    """The text with each stretch of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(text: Column, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> Column:
    """The text with every span replaced by a mark; a null text stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else redact(x, all_spans(x, vocabulary, max_ratio)[1]))

    return run(text)


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Per row the counts of base spans and all spans."""
    id_type = docs.select(id_col).dtypes[0][1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = all_spans(text or "", vocabulary, max_ratio)
                kinds = [kind for _, kind, _ in base]
                rows.append(
                    (
                        kinds.count(0),
                        kinds.count(1),
                        kinds.count(2),
                        hashlib.sha256(joined(base).encode()).hexdigest(),
                        joined(spans),
                        len(spans) - len(base),
                    )
                )
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = (
        f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_random long"
    )
    # the id goes through Python as text, because pandas has no integers with nulls
    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = read.mapInPandas(scan, schema.replace(f"doc_id {id_type}", "doc_id string", 1))
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))
