"""Operators 11 to 13 against plain versions."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelscope.llm import hard_negatives as H
from parcelscope.llm import phrases as P
from parcelscope.llm import token_counts as T
from parcelscope.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# ---- 11: token counts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" ▁ab\n\t\x00é日1.", "\U0001f600", "  ", "<s>", "</s>", "<unk>", "<0x0A>", "foo", "\xa0"]), max_size=20).map("".join))
def test_lengths_of_pre_tokens_add_up_to_the_library(text):
    assert T.Lengths({}).count([text]) == [len(T.library(T.MODEL).encode(text))]


def test_both_tiers_give_the_same_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(T.Lengths, "FULL", 10)
    texts = [f"some words {at} and " + "x" * (at % 50) for at in range(200)] + ["", "   ", "a  b   c ", "one " * 5000]
    plain = [len(T.library(T.MODEL).encode(text)) for text in texts]
    lengths = T.Lengths({" words": T.encoded_lengths([" words"])[0], " and": T.encoded_lengths([" and"])[0]})
    for _ in range(2):
        assert [n for text in texts for n in lengths.count([text])] == plain
    assert max(map(len, lengths)) <= T.LONGEST


def test_token_counts_of_odd_rows(docs_of, odd_rows):
    found = T.token_counts(docs_of(odd_rows)).collect()
    expected = Counter()
    for i, text in odd_rows:
        n = len(T.library(T.MODEL).encode(text or ""))
        expected[i, len((text or "").encode()), n, n > 4096] += 1
    assert Counter(map(tuple, found)) == expected
    assert T.token_counts(docs_of([])).count() == 0
    assert [tuple(r) for r in T.token_counts(docs_of([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 0, False), (2, 0, 0, False)]


def test_summaries_of_many_tasks_merge(spark, docs_of):
    docs = docs_of([(at, f"often often rare{at}") for at in range(300)]).repartition(70)
    kept = T.frequent_pre_tokens(docs, size=3)
    assert kept[0] == " often" and len(kept) == 3


def test_registered_token_counts_equal_the_library(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op11_token_counts"](spark, SF_DIR).collect()}
    assert found == {r["doc_id"]: len(T.library(T.MODEL).encode(r["text"] or "")) for r in rows}


# ---- 12: hard negatives


def plain_negatives(rows, is_anchor):
    """By all pairs, with whole numbers of any size."""
    kept = []
    for place, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((place, i, [int(np.floor(256 * float(x))) for x in vector], label))
    out = []
    for place, i, q, label in kept:
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), o is None, o or 0, at, k, o) for at, o, p, k in kept if at != place]
        scored.sort()
        for score, _, _, _, _, positive in [s for s in scored if s[4] == label][:5]:
            fits = [s for s in scored if s[4] != label and 50 * -score <= 100 * -s[0] <= 95 * -score]
            out += [(i, positive, rank, s[5], -score, -s[0]) for rank, s in enumerate(fits[:3], start=1)]
    return Counter(out)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("row", F.lit("x")).withColumn("slot", F.lit(1))


def check_negatives(spark, rows, kind="float"):
    found = H.hard_negatives(vectors_of(spark, rows, kind), F.col("vec_id") % 5 == 0).collect()
    assert Counter(map(tuple, found)) == plain_negatives(rows, lambda i: i % 5 == 0)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_all_pairs(spark, seed, monkeypatch):
    dice = np.random.default_rng(seed)
    monkeypatch.setattr(H, "SHELF_ROWS", (40, 65_536))
    monkeypatch.setattr(H, "TILE_ROWS", (16, 16_384))
    centres = dice.normal(0, 0.4, (6, 12))
    rows = []
    for at in range(400):
        vector = (centres[dice.integers(6)] + dice.normal(0, 0.15, 12)).astype(np.float32)
        rows.append((at, [float(x) for x in vector], int(dice.integers(4))))
    rows += [(400 + at, rows[5][1], at % 4) for at in range(60)]  # one vector many times
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[7][1], 1), (501, None, 1), (502, [None] * 12, 1), (503, [float("nan")] * 12, 1)]
    rows += [(504, [float("inf")] * 12, 1), (505, rows[9][1], None), (510, rows[9][1][:5], 2), (511, [], 2)]
    assert check_negatives(spark, rows)


def test_large_numbers_stay_exact(spark):
    dice = np.random.default_rng(3)
    rows = [(at, [float(x) for x in dice.normal(0, 40_000, 3)], at % 2) for at in range(30)]
    assert check_negatives(spark, rows, "double")


def test_few_rows(spark):
    assert check_negatives(spark, []) == []
    assert check_negatives(spark, [(5, [1.0, 0.0], 1)]) == []
    assert check_negatives(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    assert check_negatives(spark, [(5, None, 1), (None, [1.0], None)]) == []
    assert len(check_negatives(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.9], 2), (8, [0.9], 2)])) == 2


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = H.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_leave_blocks_out(spark, monkeypatch):
    dice = np.random.default_rng(5)
    points = dice.integers(-100, 100, (50, 8)).astype(float)
    anchors = dice.integers(-100, 100, (20, 8)).astype(float)
    low, high = H.bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = anchors @ points.T
    assert (low <= scores.min(axis=1, keepdims=True)).all() and (high >= scores.max(axis=1, keepdims=True)).all()
    # in clustered data an anchor reads few of the shelves
    monkeypatch.setattr(H, "SHELF_ROWS", (20, 65_536))
    monkeypatch.setattr(H, "TILE_ROWS", (8, 16_384))
    centres = np.eye(16)
    rows = [(at, [float(x) for x in centres[at % 16] + dice.normal(0, 0.02, 16)], at % 16 // 2) for at in range(640)]
    df = vectors_of(spark, rows).selectExpr(
        "monotonically_increasing_id() AS row", "vec_id", "CAST(label AS long) AS label", "vec_id % 5 = 0 AS is_anchor", "CAST(embedding AS array<double>) AS vector"
    )
    plan = H.layout(df)
    blocks = H.stored(H.hilbert_blocks(df, plan), "blocks")
    made = H.stored(H._anchors_of(blocks, plan, 5), "anchors")
    pairs = H.chosen_pairs(made, blocks, plan, True)
    tiles, shelves = made.select("tile").distinct().count(), blocks.select("shelf").distinct().count()
    assert pairs.count() < 0.5 * tiles * shelves


# ---- 13: phrases


def plain_phrases(rows, least, top, covered=80, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[at : at + n]) for at in range(len(words) - n + 1))
    out = []
    for lang, of in counts.items():
        found = {p: a for p, a in of.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in found.items():
            cuts = [(int(Fraction(2_000_000 * a, of[p[:k]] + of[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = lambda q: any(q[at : at + len(p)] == p for at in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and inside(q) and 100 * b >= covered * a for q, b in found.items()):
                rows.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts_of(spark, rows):
    full = [(at, lang, text, 1, "x") for at, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, lang string, text string, length int, word string")


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_equal_plain_counts(spark, shards):
    dice = np.random.default_rng(shards)
    words = ["a", "b", "C", "d", "é", "x\xa0y", "Z!", "q.", "\t", "new\x0bline", "the", "THE"]
    rows = [(["en", None, "und", "fr"][at % 4], " ".join(dice.choice(words, dice.integers(0, 40)))) for at in range(120)]
    rows += [("en", None), (None, None), ("fr", ""), ("en", "the the the " * 400), ("late", "only here " * 9)]
    found = P.phrase_collocations(texts_of(spark, rows), least=6, top=25, shards=shards).collect()
    assert sorted(map(tuple, found)) == plain_phrases(rows, 6, 25)


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert P.phrase_collocations(texts_of(spark, rows)).collect() == []


def test_words_and_codes():
    read = P.Words(["A b.c", "", "\t", "é  A!"], "en", 0)
    assert [read.spelt(at) for at in range(len(read.start))] == ["a", "b", "c", "é", "a"]
    a, b, c, e, again = read.found.tolist()
    assert a == again and len({a, b, c, e, 0}) == 5 and read.codes.tolist() == [a, b, 0, c, 0, e, a]
    assert P.Words(["a"], "fr", 0).found[0] != a != P.Words(["a"], "en", 1).found[0]
    assert len(P.Words([], "en", 0).codes) == 0


def test_codes_that_two_words_share_are_made_anew(spark, monkeypatch):
    rows = [("en", "one two three one two four " * 20)]
    first = P.frequent_phrases(texts_of(spark, rows), "lang", "text", 5, 4, 2)
    seeds, plain = [], P.spelling

    def clashing(copies, wanted, seed):
        seeds.append(seed)
        found = plain(copies, wanted, seed)
        return found.withColumn("clash", F.lit(True)) if seed == 0 else found

    monkeypatch.setattr(P, "spelling", clashing)
    second = P.frequent_phrases(texts_of(spark, rows), "lang", "text", 5, 4, 2)
    assert seeds == [0, 1] and first[0].count() == second[0].count()


def test_full_tables_are_handed_on(monkeypatch):
    monkeypatch.setattr(P, "_FULL", 8)
    tally, total = P.Tally(2), Counter()
    rows = np.random.default_rng(1).integers(0, 9, (200, 2)).astype(np.uint64)
    tables = [table for at in range(0, 200, 10) for table in tally.add(rows[at : at + 10])] + [tally.counted()]
    for found, times in tables:
        total.update({tuple(row): int(n) for row, n in zip(found.tolist(), times)})
    assert len(tables) > 1 and total == Counter(map(tuple, rows.tolist()))
