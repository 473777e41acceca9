"""From raw documents to token ids: five stages, each written as Parquet and read by the next one.

Every stage but the last returns the columns of its input. Quality rules remove the lines that documents of a host share and
reject documents; of near duplicates one stays; documents with a benchmark item go; secrets become a mark in the text;
the last stage encodes the texts. Where a text changes, ``n_chars`` follows.

Rows without a doc_id can't be named by an operator's result: they stay in the stages that drop documents by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.bpe import bpe_round_trip
from parcelscope.llm.decontamination import decontamination
from parcelscope.llm.near_duplicates import near_duplicates
from parcelscope.llm.quality_rules import quality_rules
from parcelscope.llm.secret_scan import redacted
from parcelscope.llm.store import stored

ORACLE_SQL = None
"""SQL can express neither token efficiency nor byte-pair encoding; tests compare with brute force."""


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules(docs).where("kept").select("input_row.*", "clean_text")
    return _with_text(kept.withColumn("text", F.col("clean_text")), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs.withColumn("text", redacted(F.col("text"))), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("bpe encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, encode) = STAGES
    for name, stage in filters:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return encode(spark, docs, sf_dir)
