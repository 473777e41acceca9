"""Hard negatives: for each anchor and each of its nearest rows of the same label, near rows of other labels.

Components become whole numbers (256 times the component, rounded down), so scores are exact inner products. All rows are put in
the order of a Hilbert curve through the ``CURVE`` dimensions of the largest variance and written as Parquet blocks of
``BLOCK`` rows, each with a zone map: the least and greatest value of every dimension and label. An anchor's inner product with
any row of a block lies between two sums over the dimensions, taken from the ends of the block's intervals. A block is
left out for an anchor if that range lies outside what the anchor can still use, or if the labels can't fit:

1. positives: an anchor scores the rows of its own shelf (neighbouring blocks) first. Its k-th best score there bounds
   the k-th best of all, and only blocks that can reach it are read;
2. negatives: every positive asks for scores from ``low`` to ``high`` percent of its own. Again the anchor's own shelf
   comes first, and raises the lower end once it has ``negatives`` rows in the window.

Anchors travel in tiles of neighbours, blocks in shelves. A pair of tile and shelf is one group of bounded size, made
only if one of the tile's anchors needs one of the shelf's blocks; inside, only the blocks are scored that an anchor
needs. Each group hands on its best rows, and the best of these are the result, so it is exact whatever the bounds leave out.

Defined results: rows with a null label, a null vector, or a null or non-finite component (also after the factor of 256)
take no part; a shorter vector counts as if zeros followed; a null id comes behind all others and is no anchor by
itself; rows that repeat are rows of their own, so copies of an anchor are among its positives and repeated anchors give
repeated rows; ties of score and id go by place; scores beyond 64 bits are cut to its ends; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

FACTOR = 256
BLOCK = 128
CURVE, CURVE_BITS = 12, 5
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SHELF_ROWS = (512, 65_536)
TILE_ROWS = (256, 16_384)
RACK_BLOCKS = 4096
_CELLS = 1 << 21  # scores held at once
_END = (1 << 63) - 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix of whole numbers, zeros behind short ones."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(FACTOR * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells with coordinates of ``bits`` bits (Skilling's transposed form)."""
    axes = list(cells.T.astype(np.int64).copy())
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for at, axis in enumerate(axes):
            turned = (axis >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(turned, below, swap)
            axes[at] = axes[at] ^ swap if at else axes[0]
    for at in range(1, len(axes)):
        axes[at] = axes[at] ^ axes[at - 1]
    carry = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        carry = np.where(axes[-1] >> bit & 1, carry ^ (1 << bit) - 1, carry)
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis ^ carry) >> bit & 1
    return key


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point between ``low`` and ``high`` of each block."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


@dataclass
class Layout:
    """What all tasks have to know: a few numbers for the whole table, and some for each dimension."""

    dims: int
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray
    parts: int
    tile_parts: int
    rack_parts: int

    @property
    def largest(self) -> int:
        return int(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))

    @property
    def is_small(self) -> bool:
        """Whether sums in floating point, and scores joined with a place in 64 bits, are exact."""
        return self.dims * self.largest**2 < 1 << 44

    @property
    def dtype(self):
        return np.int16 if self.largest < 1 << 15 else np.int32 if self.largest < 1 << 31 else np.float64

    def vectors(self, column) -> np.ndarray:
        found = np.frombuffer(b"".join(column), self.dtype).astype(np.float64)
        return found.reshape(len(column), self.dims)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        width = np.maximum(self.high - self.low, 1)[self.order]
        cells = (rows[:, self.order] - self.low[self.order]) / width * ((1 << CURVE_BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), CURVE_BITS) if len(self.order) else np.zeros(len(rows), np.int64)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.is_small:
            return (a @ b.T).astype(np.int64)
        whole = [[[int(x) for x in row] for row in rows] for rows in (a, b)]
        found = np.empty((len(a), len(b)), object)
        for i, x in enumerate(whole[0]):
            for k, y in enumerate(whole[1]):
                found[i, k] = max(-_END, min(_END, sum(p * q for p, q in zip(x, y))))
        return found

    def needed(self, anchors: np.ndarray, blocks: pd.DataFrame, label: np.ndarray, same: bool, least, most) -> np.ndarray:
        """Which anchors (rows) have to look into which blocks (columns)."""
        first, last = blocks["label_low"].to_numpy(), blocks["label_high"].to_numpy()
        if same:
            fits = (first <= label[:, None]) & (label[:, None] <= last)
        else:
            fits = (first != label[:, None]) | (last != label[:, None])
        if self.is_small:
            down, up = bounds(anchors, self.vectors(blocks["low"]), self.vectors(blocks["high"]))
            fits &= (up >= np.asarray(least, float)[:, None]) & (down <= np.asarray(most, float)[:, None])
        return fits


def layout(rows: DataFrame) -> Layout | None:
    """From one pass over all rows; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            found = matrix(vectors, int(sizes.max(initial=0)))
            out = pd.DataFrame({"dim": np.arange(-1, found.shape[1])})
            total = [float(len(batch)), *found.sum(axis=0)]
            square = [float(batch.column("is_anchor").to_numpy(zero_copy_only=False).sum()), *(found**2).sum(axis=0)]
            low = [0.0, *found.min(axis=0, initial=0)]
            high = [0.0, *found.max(axis=0, initial=0)]
            yield pa.RecordBatch.from_pandas(out.assign(total=total, square=square, low=low, high=high), preserve_index=False)

    sums = rows.select("vector", "is_anchor").mapInArrow(partial, "dim long, total double, square double, low double, high double")
    sums = sums.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("square").alias("square"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.toPandas().sort_values("dim")  # one row per dimension
    if not len(found):
        return None
    n, anchors = int(found["total"].iloc[0]), int(found["square"].iloc[0])
    each = found[found["dim"] >= 0]
    spread = each["square"].to_numpy() / n - (each["total"].to_numpy() / n) ** 2
    shelf = min(max(n // 64, SHELF_ROWS[0]), SHELF_ROWS[1])
    tile = min(max(anchors // 8, TILE_ROWS[0]), TILE_ROWS[1])
    parts = -(-n // shelf)
    return Layout(
        dims=len(each),
        low=each["low"].to_numpy(),
        high=each["high"].to_numpy(),
        order=np.argsort(-spread, kind="stable")[:CURVE],
        parts=parts,
        tile_parts=max(1, parts // max(1, -(-anchors // tile))),
        rack_parts=max(1, RACK_BLOCKS // -(-shelf // BLOCK)),
    )


_BLOCKS = "shelf long, rows binary, ids binary, no_id binary, labels binary, anchors binary, vectors binary, low binary, high binary, label_low long, label_high long"


def hilbert_blocks(rows: DataFrame, plan: Layout) -> DataFrame:
    """The blocks with their zone maps, one row each; a shelf holds the blocks of one task."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matrix(batch.column("vector"), plan.dims)
            packed = [row.tobytes() for row in found.astype(plan.dtype)]
            taken = [batch.column(name) for name in ("row", "vec_id", "label", "is_anchor")]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(plan.keys(found)), pa.array(packed, pa.binary())], ["row", "vec_id", "label", "is_anchor", "place", "vector"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), plan.dtype).reshape(len(batch), plan.dims)
            rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            ids = batch.column("vec_id").fill_null(0).to_numpy()
            no_id = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            anchors = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            shelf = batch.column("shelf").to_numpy()
            out = []
            for at in range(0, len(batch), BLOCK):
                some = slice(at, at + BLOCK)
                ends = vectors[some].min(axis=0), vectors[some].max(axis=0)
                packed = [x.tobytes() for x in (rows[some], ids[some], no_id[some], labels[some], anchors[some], vectors[some], *ends)]
                out.append((shelf[at], *packed, labels[some].min(), labels[some].max()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[name.split()[0] for name in _BLOCKS.split(", ")]))

    placed = rows.mapInArrow(keyed, "row long, vec_id long, label long, is_anchor boolean, place long, vector binary")
    placed = placed.repartitionByRange(plan.parts, "place", "row").sortWithinPartitions("place", "row")
    return placed.withColumn("shelf", F.spark_partition_id().cast("long")).mapInArrow(cut, _BLOCKS)


class Shelf:
    """Rows of some blocks in order of their ids, so that of equal scores the first column wins."""

    def __init__(self, blocks: pd.DataFrame, plan: Layout):
        def joined(name: str, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(blocks[name]), dtype)

        self.blocks = blocks
        sizes = [len(x) // 8 for x in blocks["rows"]]
        rows, ids, no_id = joined("rows", np.int64), joined("ids", np.int64), joined("no_id", bool)
        order = np.lexsort([rows, ids, no_id])
        self.rows, self.ids, self.no_id = rows[order], ids[order], no_id[order]
        self.labels, self.anchors = joined("labels", np.int64)[order], joined("anchors", bool)[order]
        self.vectors = joined("vectors", plan.dtype).reshape(len(rows), plan.dims).astype(np.float64)[order]
        self.block = np.repeat(np.arange(len(blocks)), sizes)[order]


def best_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best allowed columns as (row, column), best first; of equal ones the first column."""
    n = scores.shape[1]
    none = np.iinfo(np.int64).min if scores.dtype != object else -(1 << 200)
    joined = np.where(allowed, scores * n + (n - 1 - np.arange(n)), none)
    if k < n and scores.dtype != object:
        joined = np.partition(joined, n - k, axis=1)[:, n - k :]
    joined = np.sort(joined, axis=1)[:, ::-1][:, :k]
    row, at = np.nonzero(joined != none)
    return row, (n - 1 - joined[row, at] % n).astype(np.int64)


def _parts(n: int, columns: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, columns))
    for at in range(0, n, step):
        yield slice(at, at + step)


def search(anchors: pd.DataFrame, shelf: Shelf, plan: Layout, same: bool, k: int) -> pd.DataFrame:
    """The k best rows of a shelf in each window of each anchor: (row, slot, score, id, no_id, other).

    ``lows`` and ``highs`` hold the ends of an anchor's windows; a row of the anchor's label counts if ``same``, else one of another.
    """
    vectors, own, label = plan.vectors(anchors["vector"]), anchors["row"].to_numpy(), anchors["label"].to_numpy()
    lows, highs = anchors["lows"].tolist(), anchors["highs"].tolist()
    out = []
    for part in _parts(len(anchors), len(shelf.rows)):
        least, most = [min(x) for x in lows[part]], [max(x) for x in highs[part]]
        needed = plan.needed(vectors[part], shelf.blocks, label[part], same, least, most)
        read = np.flatnonzero(needed.any(axis=0)[shelf.block])
        if not len(read):
            continue
        scores = plan.scores(vectors[part], shelf.vectors[read])
        alike = shelf.labels[read] == label[part][:, None]
        fits = (alike & (shelf.rows[read] != own[part][:, None]) if same else ~alike) & needed[:, shelf.block[read]]
        for slot in range(max(map(len, lows[part]))):
            low = np.array([x[slot] if slot < len(x) else 1 for x in lows[part]], scores.dtype)[:, None]
            high = np.array([x[slot] if slot < len(x) else 0 for x in highs[part]], scores.dtype)[:, None]
            row, column = best_columns(scores, fits & (scores >= low) & (scores <= high), k)
            at = read[column]
            out.append(
                pd.DataFrame(
                    {
                        "row": own[part][row],
                        "slot": np.full(len(row), slot, np.int32),
                        "score": scores[row, column].astype(np.int64),
                        "id": shelf.ids[at],
                        "no_id": shelf.no_id[at],
                        "other": shelf.rows[at],
                    }
                )
            )
    return pd.concat(out) if out else pd.DataFrame(columns=["row", "slot", "score", "id", "no_id", "other"])


_FOUND = "row long, slot int, score long, id long, no_id boolean, other long"
_ANCHORS = "tile long, shelf long, row long, anchor_id long, label long, vector binary, lows array<long>, highs array<long>"


def _anchors_of(shelves: DataFrame, plan: Layout, positives: int) -> DataFrame:
    """Anchors with one window each: from the k-th best score in their own shelf upwards."""

    def own(blocks: pd.DataFrame) -> pd.DataFrame:
        shelf = Shelf(blocks, plan)
        at = np.flatnonzero(shelf.anchors)
        if not len(at):
            return pd.DataFrame({name.split()[0]: pd.Series(dtype=object) for name in _ANCHORS.split(", ")})
        found = pd.DataFrame(
            {
                "tile": int(blocks["shelf"].iloc[0]) // plan.tile_parts,
                "shelf": int(blocks["shelf"].iloc[0]),
                "row": shelf.rows[at],
                "anchor_id": shelf.ids[at],
                "label": shelf.labels[at],
                "vector": [x.tobytes() for x in shelf.vectors[at].astype(plan.dtype)],
                "lows": [[-_END]] * len(at),
                "highs": [[_END]] * len(at),
            }
        )
        best = search(found, shelf, plan, True, positives).groupby("row")["score"].agg(["size", "min"])
        floor = best.loc[best["size"] == positives, "min"].to_dict()
        return found.assign(lows=[[int(floor.get(row, -_END))] for row in found["row"]])

    return shelves.groupBy("shelf").applyInPandas(own, _ANCHORS)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def chosen_pairs(anchors: DataFrame, blocks: DataFrame, plan: Layout, same: bool) -> DataFrame:
    """(tile, shelf, anchors): for each tile the shelves with a block that one of its anchors needs, and these anchors."""

    def choose(some: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(zones):
            zones = zones.sort_values("shelf", kind="stable").reset_index(drop=True)
            shelves, starts = np.unique(zones["shelf"].to_numpy(), return_index=True)
            vectors, label = plan.vectors(some["vector"]), some["label"].to_numpy()
            least, most = [min(x) for x in some["lows"]], [max(x) for x in some["highs"]]
            wanted = [
                np.logical_or.reduceat(plan.needed(vectors[at], zones, label[at], same, least[at], most[at]), starts, axis=1)
                for at in _parts(len(some), len(zones))
            ]
            for shelf, wants in zip(shelves.tolist(), np.concatenate(wanted).T):
                if wants.any():
                    out.append((int(some["tile"].iloc[0]), shelf, _packed(some[wants].drop(columns="rack"))))
        return pd.DataFrame(out, columns=["tile", "shelf", "anchors"])

    racks = plan.parts // plan.rack_parts + 1
    tiles = plan.parts // plan.tile_parts + 1
    left = anchors.withColumn("rack", F.explode(F.sequence(F.lit(0), F.lit(racks - 1))))
    zones = blocks.select("shelf", "low", "high", "label_low", "label_high", (F.col("shelf") / plan.rack_parts).cast("int").alias("rack"))
    zones = zones.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    pairs = left.groupBy("tile", "rack").cogroup(zones.groupBy("tile", "rack"))
    return pairs.applyInPandas(choose, "tile long, shelf long, anchors binary")


def searched(pairs: DataFrame, blocks: DataFrame, plan: Layout, same: bool, k: int) -> DataFrame:
    """The k best rows in each window of each anchor, out of the pairs' shelves."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["row", "slot", "score", "id", "no_id", "other"])
        some = pa.ipc.open_stream(left["anchors"].iloc[0]).read_pandas()
        return search(some, Shelf(right, plan), plan, same, k)

    wanted = pairs.select(F.col("tile").alias("of_tile"), F.col("shelf").alias("of_shelf"))
    copies = blocks.join(wanted, F.col("shelf") == F.col("of_shelf")).drop("shelf")
    found = pairs.groupBy("tile", "shelf").cogroup(copies.groupBy("of_tile", "of_shelf")).applyInPandas(run, _FOUND)
    return best_found(found, k)


def best_found(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "no_id", "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_windows(anchors: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """Anchors with one window for each positive, and the positives' ids and scores."""
    found = positives.select("row", F.struct("rank", F.when(~F.col("no_id"), F.col("id")).alias("id"), "score").alias("one"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("one")).alias("positives"))  # at most as many as asked for
    ends = {
        "lows": f"transform(positives, x -> CAST(ceil(CAST(x.score AS DECIMAL(20,0)) * {low} / 100) AS LONG))",
        "highs": f"transform(positives, x -> CAST(floor(CAST(x.score AS DECIMAL(20,0)) * {high} / 100) AS LONG))",
    }
    joined = anchors.drop("lows", "highs").join(found, "row")
    return joined.withColumns({name: F.expr(text) for name, text in ends.items()})


def _raised(anchors: DataFrame, blocks: DataFrame, plan: Layout, k: int) -> DataFrame:
    """Windows whose lower end is the k-th best score of the anchor's own shelf, where that has as many rows."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left
        found = search(left, Shelf(right, plan), plan, False, k).groupby(["row", "slot"])["score"].agg(["size", "min"])
        floor = found.loc[found["size"] == k, "min"].to_dict()
        lows = [[floor.get((row, slot), x) for slot, x in enumerate(each)] for row, each in zip(left["row"], left["lows"])]
        return left.assign(lows=lows)

    plain = anchors.drop("positives")
    return plain.groupBy("shelf").cogroup(blocks.groupBy("shelf")).applyInPandas(run, plain.schema)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is over the id column."""
    spark = vectors.sparkSession
    number = f"CAST({vector_col} AS ARRAY<DOUBLE>)"
    whole = f"forall({number}, x -> x IS NOT NULL AND abs({FACTOR} * x) < double('infinity'))"
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.expr(whole)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("is_anchor"),
        F.expr(number).alias("vector"),
    )
    plan = layout(rows)
    if plan is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    blocks = stored(hilbert_blocks(rows, plan), "hilbert_blocks")
    anchors = stored(_anchors_of(blocks, plan, positives), "anchors")
    pairs = stored(chosen_pairs(anchors, blocks, plan, True), "positive_pairs")
    near = searched(pairs, blocks, plan, True, positives)
    asked = stored(with_windows(anchors, near, low, high), "windows")
    pairs = stored(chosen_pairs(_raised(asked, blocks, plan, negatives), blocks, plan, False), "negative_pairs")
    found = searched(pairs, blocks, plan, False, negatives).select(
        "row", "slot", "rank", F.when(~F.col("no_id"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = asked.select("row", "anchor_id", F.posexplode("positives").alias("slot", "positive"))
    return found.join(named, ["row", "slot"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.col("positive.score").alias("positive_score"),
        "negative_score",
    )
