"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest one it sees,
    then its smaller neighbours. Each step is one aggregation and one join by node; a node with very many links is a
    skewed key that adaptive execution splits. Every step is written, so a lost executor repeats one step at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        larger = stored(larger.where("a <> b").distinct(), "larger_star")
        least = larger.groupBy("a").agg(F.min("b").alias("least"))
        smaller = larger.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        own = least.select("a", F.col("least").alias("b"))
        edges = stored(smaller.unionByName(own).distinct(), "smaller_star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
