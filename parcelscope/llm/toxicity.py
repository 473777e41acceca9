"""Toxicity severity by cumulative-link ordinal regression.

Labels say whether a document is toxic. From a bounded sample of labelled documents (``max_labelled``, those with the
smallest hash of their id) the words that tell the classes apart are selected (``max_features`` by z-score of the log
odds of their document frequencies, if those differ by ``MIN_ODDS``). A toxic document's grade counts the occurrences of toxic words: 1, from ``grades[0]``
on 2, from ``grades[1]`` on 3; other documents have grade 0. The model has one weight per word, shared by all grades,
and ordered thresholds: P(grade > k) = sigmoid(w.x - t_k) with x = log(1 + occurrences). Every document's whole text is
scored; the expected severity is the sum of P(grade > k).

Words are runs of letters of any script with their marks, lower-cased. Scripts without spaces between words (Han, kana,
Thai, Khmer and their like) give pairs of neighbouring characters instead, a single character itself.

Defined results: a null or empty text has no words and gets the model's score of no evidence; without labels, or with one class only,
severity is 0 and nothing is toxic; a null id stays null and is never a labelled document; rows that repeat give rows
that repeat; only the named columns are read. Rows that share a doc_id are one document of the sample, whose counts are the
mean over the rows, rounded up; an id labelled toxic and not toxic is one document of either class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

MAX_LABELLED = 20_000
MAX_FEATURES = 256
GRADES = (3, 6)
MIN_DOCUMENTS = 5
MIN_Z = 3.5
MIN_ODDS = 2.0
LATIN_WORD = re.compile(r"[a-zªµºß-öø-ɏ]+")
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
SPACELESS = r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Yi}]"
WORD = regex.compile(rf"(?V1)([{SPACELESS}&&[\p{{L}}\p{{M}}]]+)|[[\p{{L}}\p{{M}}]--{SPACELESS}]+")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    if not BEYOND_LATIN.search(text):
        return LATIN_WORD.findall(text)
    words = []
    for found in WORD.finditer(text):
        run = found[0]
        if found[1] and len(run) > 1:
            words += map("".join, zip(run, run[1:]))
        else:
            words.append(run)
    return words


def labelled_words(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, toxic, word, total, n) of the sampled labelled documents: occurrences of the word over the id's rows.

    At most ``max_labelled`` labels are read. A row without a word holds the number of all words and, in n, of rows.
    """
    sample = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [Counter(words_of(text)) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "toxic": batch["toxic"],
                    "words": [[None, *x] for x in counts],
                    "counts": [[x.total(), *x.values()] for x in counts],
                }
            )

    joined = docs.join(F.broadcast(sample), "doc_id")
    joined = joined.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    counted = joined.mapInPandas(count, "doc_id string, toxic int, words array<string>, counts array<long>")
    counted = counted.select("doc_id", "toxic", F.inline(F.arrays_zip("words", "counts")))
    grouped = counted.groupBy("doc_id", "toxic", F.col("words").alias("word"))
    return stored(grouped.agg(F.sum("counts").alias("total"), F.count(F.lit(1)).alias("n")), "labelled_words")


def select_words(counted: DataFrame, max_features: int) -> list[tuple[str, float]]:
    """Words with the largest z-scores of their log odds; positive ones speak for toxic."""
    documents = counted.where("word IS NULL")
    total = documents.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"] or total["toxic"] in (0, total["n"]):
        return []
    bad, good = float(total["toxic"]), float(total["n"] - total["toxic"])
    held = counted.where("word IS NOT NULL").groupBy("word")
    held = held.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (bad + 1.0 - a)) - F.log(b / (good + 1.0 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    top = held.select("word", z.alias("z"), odds.alias("odds"))
    top = top.where((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS))
    return [(x["word"], x["z"]) for x in top.orderBy(F.abs("z").desc(), "word").limit(max_features).collect()]


class OrdinalModel:
    """Weights shared by all grades and ordered thresholds. The last two are for the number and the share of all toxic words."""

    def __init__(self, selected: list[tuple[str, float]], weights: np.ndarray, thresholds: np.ndarray):
        self.number = {word: at for at, (word, _) in enumerate(selected)}
        self.evidence = {word for word, z in selected if z > 0}
        self.weights, self.thresholds = weights, thresholds

    def features(self, counts: dict[str, int], n_words: int) -> np.ndarray:
        x = np.zeros(len(self.number) + 2)
        for word, count in counts.items():
            x[self.number[word]] = np.log1p(count)
        hits = sum(count for word, count in counts.items() if word in self.evidence)
        x[-2:] = np.log1p(hits), np.log1p(100 * hits / max(1, n_words))
        return x

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -500, 500)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 400, l2: float = 1e-3, rate: float = 0.1):
    """Maximum likelihood by Adam. Thresholds are a first one plus positive gaps, so they stay ordered."""
    n, d = x.shape
    params = np.concatenate([np.zeros(d), [0.0], np.zeros(grades - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])

    for step in range(1, steps + 1):
        t = thresholds(params)
        s = 1 / (1 + np.exp(np.clip(t[None, :] - (x @ params[:d])[:, None], -500, 500)))
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        scale = 1 / p / n
        by_score = (slope[at, y] - slope[at, y + 1]) * scale
        by_threshold = np.zeros((n, grades + 1))
        by_threshold[at, y] -= slope[at, y] * scale
        by_threshold[at, y + 1] += slope[at, y + 1] * scale
        dt = by_threshold[:, 1:-1].sum(axis=0)
        gaps = np.array([dt[k:].sum() * np.exp(params[d + k]) for k in range(1, grades - 1)])
        ascent = np.concatenate([x.T @ by_score - l2 * params[:d], [dt.sum()], gaps])
        first = 0.9 * first + 0.1 * ascent
        second = 0.999 * second + 0.001 * ascent**2
        params = params + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:d], thresholds(params)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
    grades: tuple[int, int] = GRADES,
) -> OrdinalModel | None:
    counted = labelled_words(docs, labels, max_labelled)
    selected = select_words(counted, max_features)
    if not selected:
        return None
    model = OrdinalModel(selected, np.zeros(len(selected) + 2), np.zeros(1 + len(grades)))
    none, mean = F.col("word").isNull(), F.ceil(F.col("total") / F.col("rows")).cast("int")
    of_id = counted.where(none | F.col("word").isin(list(model.number))).groupBy("doc_id", "toxic")
    of_id = of_id.agg(
        F.max(F.when(none, F.col("n"))).alias("rows"),
        F.max(F.when(none, F.col("total"))).alias("total"),
        F.sort_array(F.collect_list(F.when(~none, F.struct("word", "total")))).alias("found"),
    )
    mean_of = F.transform("found", lambda x: F.struct(x["word"], F.ceil(x["total"] / F.col("rows")).cast("int")))
    rows = of_id.select("doc_id", "toxic", mean.alias("n_words"), mean_of.alias("found")).orderBy("doc_id", "toxic")
    rows = rows.collect()  # at most max_labelled x max_features numbers, however many rows share an id
    x = np.array([model.features(dict(map(tuple, row["found"])), row["n_words"]) for row in rows])
    hits = [sum(count for word, count in row["found"] if word in model.evidence) for row in rows]
    y = np.array([0 if not row["toxic"] else 1 + sum(n >= limit for limit in grades) for row, n in zip(rows, hits)])
    model.weights, model.thresholds = fit_ordinal(x, y, 2 + len(grades))
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    id_type = docs.select(id_col).dtypes[0][1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            severity, toxic = np.zeros(len(batch)), np.zeros(len(batch))
            if model and len(batch):
                words = [words_of(text) for text in batch["text"]]
                found = [Counter(w for w in each if w in model.number) for each in words]
                above = model.above(np.array([model.features(x, len(each)) for x, each in zip(found, words)]))
                severity, toxic = above.sum(axis=1), above[:, 0]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "severity": severity, "p_toxic": toxic, "toxic": toxic >= 0.5}
            )

    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = read.mapInPandas(score, "doc_id string, severity double, p_toxic double, toxic boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def ordinal_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Expected severity of every document, from a model fitted to the labelled ones."""
    read = docs.select("doc_id", "text")
    return score_toxicity(read, fit_toxicity(read, labels, **options))
