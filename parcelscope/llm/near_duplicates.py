"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with equal sets form a class, and only one document of
each class takes part. ``TREES`` random trees branch the classes: a node selects ``BRANCHES`` of ``COORDINATES``
minwise hash functions, and a document goes to the child of each that stands for its own minwise token. Nodes of up to
``NODE`` documents are compared exhaustively on their full sets; larger ones branch again. At similarity 0.8 one tree
finds a pair with probability 0.94. All trees draw from the same functions, so a pair that agrees in few of them is
missed by all trees more often: together they find a pair with probability 0.99992 at three levels, 0.99987 at five
(over the binomial number of agreeing functions, branches within a tree taken as independent).

Nodes that hold the same documents are compared once, and after the first tree only nodes whose documents aren't all in
one component yet. Within a node a document is compared with all others unless it is in the node's largest component
already, since links inside a component change nothing. So what a node gives is a spanning forest, never all pairs.

Large nodes of the first tree are dealt into blocks that are compared inside, which connects most of a large group. After that
the documents of a large node that are outside its largest component are compared with all its blocks if they are at most
``NODE``, and else the node branches on; after ``LEVELS`` levels they are compared however many they are. So no pair
of a node is left out unless both are already known to be connected.

Defined results: a text without words has the empty set, links with nothing and is kept. A null id links with nothing,
has a null component and is kept. Rows with equal ids are one document with one text, and all of them have its result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stored
from .texts import GOLDEN, WordHashes, chunks, mixed, shingles, split_words

SHINGLE = 5
PERCENT = 80
TREES = 4
BRANCHES = 2
FIRST_LEVELS = 3
LEVELS = 5
COORDINATES = 64
NODE = 500
NODE_SHINGLES = 2_000_000
FILTER_BITS = 24

_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(split_words(text)), size))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its smallest hash under every function, 32 bits each."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    values = np.concatenate(sets)
    found = np.empty((len(sets), COORDINATES), np.uint32)
    for at, factor in enumerate(FACTORS):
        found[:, at] = np.minimum.reduceat((values * factor) >> np.uint64(32), starts)
    return found


def sketched(batch: pd.DataFrame, size: int, hashes: WordHashes) -> Iterator[pd.DataFrame]:
    """Sketches of the rows of ``batch``, a few at a time: the sets of a whole batch take more memory than its texts."""
    ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
    for few in chunks(texts):
        sets = [shingle_set(text, size, hashes) for text in texts[few]]
        tokens: list[bytes | None] = [None] * len(sets)
        full = [at for at, x in enumerate(sets) if len(x)]
        for first in range(0, len(full), 64):
            part = full[first : first + 64]
            for at, row in zip(part, minwise([sets[x] for x in part])):
                tokens[at] = row.tobytes()
        keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        yield pd.DataFrame(
            {
                "doc_id": ids[few],
                "n_shingles": [len(x) for x in sets],
                "k1": [int.from_bytes(x[:8], "little", signed=True) for x in keys],
                "k2": [int.from_bytes(x[8:], "little", signed=True) for x in keys],
                "tokens": tokens,
            }
        )


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, tokens): set size, 128-bit key of the set, and its minwise tokens."""
    id_type = dict(docs.dtypes)["doc_id"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield from sketched(batch, size, hashes)

    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = read.mapInPandas(sketch, "doc_id string, n_shingles long, k1 long, k2 long, tokens binary")
    return stored(found.withColumn("doc_id", F.col("doc_id").cast(id_type)), "sketches")


def branch(members: DataFrame, levels: int) -> DataFrame:
    """Children (node, rep, n_shingles, first) of members, which have tokens too, ``levels`` further down."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(-1, COORDINATES)
            nodes = batch["node"].to_numpy(np.int64).view(np.uint64)
            rows = np.arange(len(batch))
            for _ in range(levels):
                children = []
                for at in range(BRANCHES):
                    chosen = mixed(mixed(nodes + GOLDEN) * GOLDEN + np.uint64(at))
                    coordinate = chosen % np.uint64(COORDINATES)
                    token = tokens[rows, coordinate.astype(np.int64)].astype(np.uint64)
                    children.append(mixed(mixed(chosen + GOLDEN) + token))
                nodes, rows = np.concatenate(children), np.tile(rows, BRANCHES)
            yield pd.DataFrame(
                {
                    "node": nodes.view(np.int64),
                    "rep": batch["rep"].to_numpy()[rows],
                    "n_shingles": batch["n_shingles"].to_numpy()[rows],
                    "first": batch["first"].to_numpy()[rows],
                }
            )

    id_type = dict(members.dtypes)["rep"]
    schema = f"node long, rep {id_type}, n_shingles int, first boolean"
    return members.select("node", "rep", "n_shingles", "first", "tokens").mapInPandas(run, schema)


def perhaps_among(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``column`` may be in the only column of ``wanted``: all that are, and some others.

    For a join that follows: every task gets a set of ``1 << FILTER_BITS`` bits, at most 2 ** 18 rows, so that only rows
    on a bit of a wanted value are shuffled. A set that fills up lets more rows through and changes nothing.
    """

    def place(name: str) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
        return F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")

    word, at = place(wanted.columns[0])
    one_bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    bits = wanted.select(word.alias("filter_word"), one_bit.alias("filter_bit"))
    bits = bits.groupBy("filter_word").agg(F.bit_or("filter_bit").alias("filter_bits"))
    word, at = place(column)
    held = F.call_function("shiftright", F.col("filter_bits"), at).bitwiseAND(1) == 1
    return table.join(F.broadcast(bits), (word == F.col("filter_word")) & held, "left_semi")


def shared_nodes(rows: DataFrame, node: int, known: DataFrame | None = None) -> DataFrame:
    """Members of nodes with two documents or more, of nodes with the same members once; with ``known`` components only
    of nodes that hold more than one. ``blocks`` tells into how many parts a node must be dealt to be compared."""
    held = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    # written as it is read twice: few nodes are shared, and all rows move to find them
    members = stored(_labelled(rows.join(held, "node"), known), "held_nodes")
    sizes = members.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("shingles"),
        F.bit_xor(F.xxhash64("rep")).alias("same"),
        F.min("rep").alias("low"),
        F.max("first").alias("first"),
        (F.min("label") != F.max("label")).alias("mixed"),
    )
    sizes = sizes.where("mixed").groupBy("n", "shingles", "same", "low")
    sizes = sizes.agg(F.min_by("node", F.struct(~F.col("first"), F.col("node"))).alias("node"), F.max("first").alias("first"))
    blocks = F.greatest(F.ceil(F.col("n") / node), F.ceil(F.col("shingles") / NODE_SHINGLES)).cast("int")
    sizes = sizes.select("node", "first", "n", F.when(F.col("n") == 2, 1).otherwise(blocks).alias("blocks"))
    return stored(members.drop("first").join(sizes, "node"), "shared_nodes")


def linked(sets: list[np.ndarray], label: list, must: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents with different labels.

    Documents marked in ``must`` are compared with all others; if all are, those of the largest component may be left
    out, because then only pairs inside it aren't compared.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    numbers = {x: at for at, x in enumerate(dict.fromkeys(label))}
    own = np.array([numbers[x] for x in label])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, holders = values[order], owner[order]
    found, waiting = [], must.copy()
    while True:
        counts = np.bincount(own)
        candidates = waiting & (own != counts.argmax()) if must.all() else waiting
        if counts.max() == n or not candidates.any():
            return found
        at = int(np.flatnonzero(candidates)[0])
        waiting[at] = False
        first, last = np.searchsorted(values, sets[at], "left"), np.searchsorted(values, sets[at], "right")
        lengths = last - first
        places = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(holders[places], minlength=n)
        near = 100 * shared >= percent * (sizes + sizes[at] - shared)
        for other in np.flatnonzero(near & (own != own[at])):
            if own[other] != own[at]:
                found.append((at, int(other)))
                own[own == own[other]] = own[at]


def compare(members: DataFrame, keys: list[str], size: int, percent: int, id_type: str) -> DataFrame:
    """Links (a, b) of a spanning forest of each group of members (keys, rep, label, must, text)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        group = group.sort_values(["rep", "must"], ascending=[True, False]).drop_duplicates("rep")
        sets = [shingle_set(text, size, hashes) for text in group["text"]]
        pairs = linked(sets, group["label"].tolist(), group["must"].to_numpy(bool), percent)
        rep = group["rep"].to_numpy()
        return pd.DataFrame({"a": [rep[a] for a, _ in pairs], "b": [rep[b] for _, b in pairs]})

    return members.groupBy(*keys).applyInPandas(run, f"a {id_type}, b {id_type}")


def _labelled(members: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return members.withColumn("label", F.col("rep"))
    joined = members.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.withColumn("label", F.coalesce("component", "rep")).drop("component")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    trees: int = TREES,
    node: int = NODE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(read.dtypes)["doc_id"]
    sets = sketches(read, shingle)
    known_sets = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known_sets.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n_shingles"), F.first("tokens").alias("tokens")
    )
    classes = stored(classes, "classes")
    roots = F.explode(F.array(*[F.lit(tree).cast("long") for tree in range(trees)]))
    rows = branch(classes.withColumn("node", roots).withColumn("first", F.col("node") == 0), FIRST_LEVELS)
    members = shared_nodes(stored(rows, "branches"), node)
    # the texts of all documents that share a node, fetched once
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = perhaps_among(read, "doc_id", needed).join(needed, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))
    texts = stored(texts, "node_texts")

    def compared(rows: DataFrame) -> DataFrame:
        return compare(rows.join(texts, "rep"), ["node", "block", "part"], shingle, percent, id_type)

    links = stored(compared(_in_blocks(members.where("first"))), "links")
    known = stored(components(links), "components")
    links = known.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what they connect is all that counts
    rows = members.where("NOT first OR blocks > 1").select("node", "rep", "n_shingles", "first")
    for level in range(FIRST_LEVELS, LEVELS + 1):
        members = _with_main(shared_nodes(rows, node, known))
        # few documents outside the largest component: compared with all others; a small node is compared whole
        small, few = F.col("blocks") == 1, F.col("others") <= node
        if level == LEVELS:
            few = F.lit(True)
        new = compared(_in_blocks(members.where(small))).unionByName(compared(_across_blocks(members.where(~small & few), node)))
        links = stored(links.unionByName(new), "links")
        large = members.where(~small & ~few).select("node", "rep", "first")
        if level == LEVELS or large.isEmpty():
            break
        wanted = perhaps_among(classes.select("rep", "n_shingles", "tokens"), "rep", large.select("rep"))
        rows = branch(large.join(wanted, "rep"), 1)
        rows = stored(rows, "branches")
    known = stored(components(links), "components")
    final = classes.select("k1", "k2", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    joined = sets.select("doc_id", "n_shingles", "k1", "k2").join(final, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("component_id"))
    component = component.otherwise(F.col("doc_id")).cast(id_type)
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of nodes dealt into blocks; a small node is one block."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return members.select("node", block.alias("block"), F.lit(0).alias("part"), "rep", "label", F.lit(True).alias("must"))


def _with_main(members: DataFrame) -> DataFrame:
    """Adds the node's largest component and the number of documents outside it."""
    per_label = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("held"))
    main = per_label.groupBy("node").agg(
        F.max_by("label", F.struct("held", "label")).alias("main"), (F.sum("held") - F.max("held")).alias("others")
    )
    return stored(members.join(main, "node"), "main_components")  # read by each of the comparisons


def _across_blocks(members: DataFrame, node: int) -> DataFrame:
    """Members of large nodes dealt so that documents outside the largest component meet all blocks."""
    placed = members.withColumn("must", F.col("label") != F.col("main"))
    parts = F.ceil(F.col("others") / node).cast("int")
    block, part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep"), parts).cast("int")
    as_member = placed.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_other = placed.where("must").withColumn("part", part).withColumn("block", every)
    as_member = as_member.withColumn("must", F.lit(False))
    return as_other.unionByName(as_member).select("node", "block", "part", "rep", "label", "must")
