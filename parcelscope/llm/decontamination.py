"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Texts are lower-cased runs of letters and digits. A window of as many words as a benchmark item has, and the item
itself, are multisets of their shingles of five words, each shingle weighted by how often it occurs. Both get a 64-bit SimHash:
a bit is set if more than half of the weight has it set. The bits are cut into ``RADIUS`` + 1 blocks; two fingerprints
that differ in at most ``RADIUS`` bits agree in one block at least, so looking up equal blocks among items of the
window's size finds all of them. Candidates are verified exactly: weighted Jaccard similarity of at least ``PERCENT`` %.
At that limit 9.7 bits differ on average with a deviation of 2.9, so the radius leaves out 2 pairs in 10,000.

Most windows hold no shingle of any item and so have similarity 0 to all of them; windows are made only around shingles that occur in an
item, in the sizes of the items that have them. Long texts are cut into stretches of ``STRETCH`` window starts, which overlap
by the largest item, so no task holds more than a stretch at a time and every window belongs to one stretch.

Benchmark shingles and item blocks are broadcast up to ``MAX_BROADCAST`` rows, which is checked; beyond it the same joins shuffle.

Defined results: a text or item with fewer than five words has no shingles and is in no result; in a text shorter than
an item the window is the whole text; null texts are empty; a null id gives rows with a null id; rows that repeat give one result; equal similarity goes to the first window; only
the named columns are read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

SHINGLE = 5
PERCENT = 80
RADIUS = 20
STRETCH = 256
MAX_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str) -> str:
    parts = ", ".join(f"{words}[p + {at}]" if at else f"{words}[p]" for at in range(SHINGLE))
    last = f"size({words}) - {SHINGLE}"
    return f"IF({last} < 0, CAST(array() AS array<bigint>), transform(sequence(0, greatest(0, {last})), p -> xxhash64({parts})))"


def _with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` and ``counted`` (each shingle with the number of its occurrence) from ``shingles``."""
    ones = [f"size(filter(shingles, x -> (x & {1 << bit}L) <> 0)) * 2 > size(shingles)" for bit in range(63)]
    ones.append("size(filter(shingles, x -> x < 0)) * 2 > size(shingles)")
    bits = [f"shiftleft(CAST({one} AS BIGINT), {bit})" for bit, one in enumerate(ones)]
    counted = """IF(size(array_distinct(shingles)) = size(shingles), transform(shingles, x -> xxhash64(x, 0)),
        transform(shingles, (x, i) -> xxhash64(x, size(filter(slice(shingles, 1, i), y -> y = x)))))"""
    return df.withColumn("fingerprint", F.expr(" | ".join(bits))).withColumn("counted", F.expr(counted))


def _block_edges(radius: int) -> list[tuple[int, int]]:
    cuts = [64 * at // (radius + 1) for at in range(radius + 2)]
    return list(zip(cuts, cuts[1:]))


def _blocks(fingerprint: str, radius: int) -> Column:
    parts = [f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L" for a, b in _block_edges(radius)]
    return F.expr(f"array({', '.join(parts)})")


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, shingles, fingerprint, counted) of the items that have shingles."""
    read = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    cut = read.select("item_id", F.size("words").alias("size"), F.expr(_shingles("words")).alias("shingles"))
    return stored(_with_fingerprint(cut.where("size(shingles) > 0")), "items")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def candidate_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, size, shingles, fingerprint, counted) of windows that hold a shingle of an item of their size."""
    known = items.select("size", F.explode("shingles").alias("shingle")).groupBy("shingle")
    known = stored(known.agg(F.collect_set("size").alias("sizes")), "item_shingles")
    largest = items.agg(F.max("size")).first()[0] or 1
    words = docs.select("doc_id", words_of(F.col("text")).alias("all_words"))
    stretches = words.select(
        "doc_id",
        "all_words",
        F.explode(F.expr(f"sequence(0, CAST(greatest(0, (size(all_words) - 1) DIV {STRETCH}) AS INT))")).alias("stretch"),
    ).select(
        "doc_id",
        "stretch",
        F.expr(f"slice(all_words, stretch * {STRETCH} + 1, {STRETCH + largest - 1})").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    places = stretches.where(F.size("words") >= SHINGLE).select(
        "*", F.explode(F.expr(f"sequence(0, size(words) - {SHINGLE})")).alias("p")
    )
    parts = ", ".join(f"words[p + {at}]" if at else "words[p]" for at in range(SHINGLE))
    hits = places.withColumn("shingle", F.expr(f"xxhash64({parts})")).join(_bounded(known, known.count()), "shingle")
    found = hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("stretch").alias("stretch"),
        F.first("words").alias("words"),
        F.collect_list(F.struct("p", "sizes")).alias("hits"),
    )
    first = f"greatest(0, h.p - z + {SHINGLE})"
    last = f"least(h.p, {STRETCH - 1}, greatest(0, size(words) - z))"
    starts = f"IF({first} <= {last}, transform(sequence({first}, greatest({first}, {last})), s -> shiftleft(CAST(z AS BIGINT), 20) + s), CAST(array() AS array<bigint>))"
    # a shorter window is only for texts shorter than the item
    fits = "filter(h.sizes, z -> stretch = 0 OR size(words) >= z)"
    windows = f"array_distinct(flatten(transform(hits, h -> flatten(transform({fits}, z -> {starts})))))"
    made = found.withColumn("all_shingles", F.expr(_shingles("words"))).withColumn("window", F.explode(F.expr(windows)))
    size = F.shiftright("window", 20).cast("int")
    cut = made.select(
        "doc_id", "stretch", (F.col("window") % (1 << 20)).cast("int").alias("start"), size.alias("size"), F.least(size, F.size("words")).alias("n_words"), "all_shingles"
    )
    cut = cut.select(
        "doc_id",
        (F.col("stretch").cast("long") * STRETCH + F.col("start")).alias("start_word"),
        "n_words",
        "size",
        F.expr(f"slice(all_shingles, start + 1, n_words - {SHINGLE - 1})").alias("shingles"),
    )
    return _with_fingerprint(cut)


def decontamination(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each document for each item it holds."""
    known = benchmark_items(items)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = stored(candidate_windows(read, known), "windows")
    blocks = _blocks("fingerprint", radius)
    of_items = known.select(
        "item_id",
        F.col("size").alias("item_size"),
        F.col("fingerprint").alias("item_fingerprint"),
        F.col("counted").alias("item_counted"),
        F.posexplode(blocks).alias("item_at", "item_block"),
    )
    of_windows = windows.select("*", F.posexplode(blocks).alias("at", "block"))
    same = (F.col("size") == F.col("item_size")) & (F.col("at") == F.col("item_at")) & (F.col("block") == F.col("item_block"))
    pairs = of_windows.join(_bounded(of_items, known.count() * (radius + 1)), same)
    near = pairs.where(F.bit_count(F.expr("fingerprint ^ item_fingerprint")) <= radius)
    # a pair is looked at once, in the first block in which both agree
    equal = " ".join(
        f"WHEN shiftrightunsigned(fingerprint ^ item_fingerprint, {a}) & {(1 << (b - a)) - 1}L = 0 THEN {at}"
        for at, (a, b) in enumerate(_block_edges(radius))
    )
    near = near.where(F.expr(f"at = CASE {equal} END"))
    shared = F.size(F.array_intersect("counted", "item_counted"))
    checked = near.withColumn("shared", shared).withColumn("total", F.size("counted") + F.size("item_counted") - F.col("shared"))
    checked = checked.where(100 * F.col("shared") >= percent * F.col("total")).withColumn("similarity", F.col("shared") / F.col("total"))
    best = F.max_by(F.struct("start_word", "n_words"), F.struct(F.col("similarity"), -F.col("start_word"), F.col("n_words"))).alias("best")
    grouped = checked.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best)
    return grouped.select("doc_id", "item_id", "similarity", F.col("best.start_word").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"))
