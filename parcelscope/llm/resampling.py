"""Importance resampling towards a target set.

Words and word pairs of a text are hashed into ``buckets``. The raw model has the share of each bucket among all
documents, the target model among a bounded sample of documents labelled good (``max_target``, those with the smallest
hash of their id). A document's log weight is the sum of log(target share / raw share) over its n-grams. Gumbel noise is added,
made from a hash of the id, and the k largest sums are kept: a draw without replacement in proportion to the weights.
k is a share of the documents; by default the share of good ones among the labelled.

Defined results: a null or empty text has log weight 0; a null id has noise of its own kind and stays null; rows with
the same id have the same noise; ties at the border are settled by id and place; without labels of good documents all
log weights are 0 and all documents are kept; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharding import with_prefix_sums
from .store import stored
from .texts import GOLDEN, WordHashes, chunks, mixed, split_words

BUCKETS = 10_000
MAX_TARGET = 20_000
SMOOTHING = 1.0


def ngram_buckets(texts, hashes: WordHashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of some texts, and for each the number of its text."""
    words = [split_words(text) for text in texts]
    sizes = np.array([len(x) for x in words])
    one = hashes.of([word for each in words for word in each])
    owner = np.repeat(np.arange(len(words)), sizes)
    same = owner[1:] == owner[:-1]
    two = mixed(one[:-1] * GOLDEN + one[1:])[same]
    found = np.concatenate([one, two]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs in all documents and in those with ``is_target``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, raw, target = WordHashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, wanted = batch["text"].tolist(), batch["is_target"].to_numpy(bool)
            for part in chunks(texts):
                found, owner = ngram_buckets(texts[part], hashes, buckets)
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[wanted[part][owner]], minlength=buckets)
        yield pd.DataFrame({"bucket": np.arange(buckets), "raw": raw, "target": target})

    per_task = docs.select("text", "is_target").mapInPandas(count, "bucket long, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: pd.DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(buckets)
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, log_weight, gumbel) of every document."""
    id_type = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            texts, weights = batch["text"].tolist(), np.zeros(len(batch))
            for part in chunks(texts):
                found, owner = ngram_buckets(texts[part], hashes, len(ratios))
                weights[part] = np.bincount(owner, ratios[found], minlength=len(weights[part]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "noise": batch["noise"], "log_weight": weights})

    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.lit(seed), "doc_id").alias("noise"), "text")
    scored = read.mapInPandas(score, "doc_id string, noise long, log_weight double")
    uniform = (F.shiftrightunsigned("noise", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return scored.select(F.col("doc_id").cast(id_type).alias("doc_id"), "log_weight", (-F.log(-F.log(uniform))).alias("gumbel"))


def importance_resampling(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    buckets: int = BUCKETS,
    max_target: int = MAX_TARGET,
    seed: int = 7,
) -> DataFrame:
    """Per document its log weight, noise, rank by their sum and whether it is among the k drawn."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("is_target", F.lit(True))
    read = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")  # at most max_target rows
    read = read.withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    ratios = log_ratios(ngram_counts(read, buckets).toPandas(), buckets)  # one row per bucket
    scored = stored(log_weights(docs.select("doc_id", "text"), ratios, seed).withColumn("one_", F.lit(1)), "log_weights")
    if share is None:
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] if ratios.any() else 1.0
    n = scored.count()
    k = min(n, math.ceil(share * n))
    keyed = scored.withColumn("key_", -(F.col("log_weight") + F.col("gumbel")))
    ranked = with_prefix_sums(keyed, ["key_", "doc_id"], "one_")
    return ranked.select("doc_id", "log_weight", "gumbel", F.col("at_").alias("rank"), (F.col("at_") < k).alias("kept"))
