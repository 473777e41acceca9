"""Quality rules: statistics of one text, and lines that many documents of one host share.

A line is looked at in its normal form: lower case, white space at its ends removed, runs of white space as one space.
Lines without a word don't count. Per host, the distinct documents that hold a line are counted, copies of a whole
text once. A line held by more than ``min_documents`` and by more than ``max_share`` of the host's documents is
removed. A document that loses more than ``max_lost`` of its words is depleted and rejected.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; rows that repeat
give rows that repeat; only the named columns are read, so others may have any name.

All work is done by DataFrame functions. Removed lines are joined by host and line, so a host may have any number of
them; what a document gets back is the list of its own removed lines, by the hash of its text. Texts that lose no line
don't move: a bit set of 2 ** ``BITS`` bits (at most 2 MB as it is broadcast) tells which hashes may have a list, and
only those are joined with theirs. What goes to the join are counts and the hashes of lines, and the text if the cleaned
one is asked for. A bit that a foreign text shares costs its way to the join and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

SYMBOLS = "#*$%&|<>"
MIN_DOCUMENTS = 20
MAX_LOST = 0.5
BITS = 23
MIN_WORDS = 50
MAX_REPEATED = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _normal(line: Column) -> Column:
    odd = line.startswith(" ") | line.endswith(" ") | F.contains(line, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(space))
    return F.lower(F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by 3-word windows that occur at least twice.

    The upper bits of a window's hash and its place share one number, so that equal windows become neighbours in a
    plain sort of numbers; neighbours are then compared by their words. Each step is a column of its own, so that the
    array functions run in generated code.
    """
    steps = {
        "n_": "size(words)",
        "mask_": "shiftleft(-1L, greatest(8, length(bin(n_))))",
        "keys_": """slice(transform(words, (w, i) ->
            (xxhash64(w, get(words, i + 1), get(words, i + 2)) & mask_) | i), 1, greatest(n_ - 2, 0))""",
        "sorted_": "sort_array(keys_)",
        "next_": "slice(sorted_, 2, n_)",
        "equal_": "filter(transform(sorted_, (x, i) -> IF((x ^ get(next_, i)) & mask_ = 0, i, -1)), i -> i >= 0)",
        "pairs_": """filter(transform(equal_, i -> named_struct('p', CAST(sorted_[i] & ~mask_ AS INT),
            'q', CAST(next_[i] & ~mask_ AS INT))),
            x -> words[x.p] = words[x.q] AND words[x.p + 1] = words[x.q + 1] AND words[x.p + 2] = words[x.q + 2])""",
        "covered_": """size(array_distinct(flatten(transform(pairs_, x ->
            array(x.p, x.p + 1, x.p + 2, x.q, x.q + 1, x.q + 2)))))""",
    }
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    return df.withColumn("n_repeat_words", F.expr("CAST(covered_ AS BIGINT)")).drop(*steps)


def _by_loss(read: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that may have removed lines, and those that have none; both with the hash of the text."""
    words = F.lit(1 << BITS - 6)
    word_of = lambda copy: F.pmod(F.shiftrightunsigned(copy, 6), words)
    bit = F.expr("shiftleft(1L, CAST(copy_ & 63 AS INT))")
    sets = removed.groupBy(word_of(F.col("copy_")).alias("word_")).agg(F.bit_or(bit).alias("bits_"))
    hashed = read.withColumn("copy", F.xxhash64("text"))
    marked = hashed.join(F.broadcast(sets), word_of(F.col("copy")) == F.col("word_"), "left")  # 2 ** (BITS - 6) rows at most
    has = F.expr("coalesce(getbit(bits_, CAST(copy & 63 AS INT)) = 1, false)")
    return marked.where(has).select(*hashed.columns), marked.where(~has).select(*hashed.columns)


def _counted(read: DataFrame) -> DataFrame:
    """Adds the base counts, ``base_failed`` and for each line its hash and number of words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = _with_repeated_words(read.withColumn("words", words_of(F.col("text"))).withColumn("lines", _lines(text)))
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    sizes = F.transform(
        F.transform("lines", _normal),
        lambda line: F.named_struct(F.lit("line"), F.xxhash64(line), F.lit("words"), F.size(F.split(line, " "))),
    )
    # inline keeps the optimizer from writing the steps above out again in every filter on the counts
    counted = cut.select(*read.columns, sizes.alias("sizes_"), F.inline(F.array(counts)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def text_rules(
    docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Per document: host, text, the base counts with ``base_failed``, the ``removed`` lines and the words on them.

    All is counted where the text is read; to the join with its list goes the text itself only if the caller takes it.
    """
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(host_col).alias("host"),
        F.struct(*[F.col(name) for name in docs.columns]).alias("input_row"),
    )
    some, none = map(_counted, _by_loss(read, removed))
    same = F.col("host").eqNullSafe(F.col("host_")) & (F.col("copy") == F.col("copy_"))
    lost = F.expr(
        """CASE WHEN removed IS NULL THEN 0L ELSE CAST(aggregate(
             filter(sizes_, l -> array_contains(removed, l.line)), 0, (n, l) -> n + l.words) AS BIGINT) END"""
    )
    some = some.join(removed, same, "left").withColumn("lost_words", lost).drop("host_", "copy_", "copy", "sizes_")
    none = none.withColumn("removed", F.lit(None).cast("array<bigint>")).withColumn("lost_words", F.lit(0).cast("long"))
    return none.drop("copy", "sizes_").unionByName(some)


def removed_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """(host_, copy_, removed array<long>): for each text with lines above the limit, their hashes.

    A text stands for all its copies on its host. Should two texts share a hash, they share a list of lines that are removed
    on their host anyway, and each loses those it has.
    """
    read = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    line_hashes = F.array_distinct(F.transform(_lines(F.col("text")), lambda line: F.xxhash64(_normal(line))))
    held = read.where("text IS NOT NULL").select("host", F.xxhash64("text").alias("copy"), F.explode(line_hashes).alias("line"))
    held = stored(held.distinct(), "held_lines")
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents)
    above = counts.select(F.col("host").alias("host_"), F.col("line").alias("line_"))
    found = held.join(above, F.col("host").eqNullSafe(F.col("host_")) & (F.col("line") == F.col("line_")))
    return found.groupBy("host_", F.col("copy").alias("copy_")).agg(F.collect_list("line").alias("removed"))


def quality_rules(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    max_lost: float = MAX_LOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Per document the base counts, the words on removed lines, ``kept``, the cleaned text and the row it came from.

    The lists of removed lines are written once and joined by host and hash of the text, where skewed keys are split.
    """
    removed = stored(removed_lines(docs, min_documents, text_col, host_col), "removed_lines")
    joined = text_rules(docs, removed, id_col, text_col, host_col)
    clean = F.when(
        F.col("lost_words") > 0,
        F.concat_ws(
            "\n",
            F.filter(
                F.split("text", "\n"), lambda line: ~F.array_contains("removed", F.xxhash64(_normal(line)))
            ),
        ),
    ).otherwise(F.col("text"))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= F.lit(max_lost) * F.col("n_words"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("kept"),
        "lost_words",
        clean.alias("clean_text"),
        "input_row",
    )
