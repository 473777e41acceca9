"""What operators move between tasks and to the driver."""

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from parcelscope.llm import bpe, masked_lm, near_duplicates, phrases, quality_rules
from parcelscope.llm.texts import WordHashes


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quality_verdicts_move_no_texts(docs_of, no_broadcast, capsys):
    """(op1) Counts and hashes of lines go to the join with the removed lines, the text only for its cleaned form."""
    rows = [(at, f"own {at} line of some words\na line of many") for at in range(30)]
    out = quality_rules.quality_rules(docs_of(rows))

    def moved(df):
        df.explain("formatted")
        return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)

    verdicts = moved(out.drop("clean_text", "input_row"))
    assert verdicts and not any(re.search(r"\btext#", columns) for columns in verdicts)
    assert any(re.search(r"\btext#", columns) for columns in moved(out))
    found = {(r.doc_id, r.n_words, r.lost_words, r.clean_text) for r in out.collect()}
    assert found == {(at, 10, 4, f"own {at} line of some words") for at in range(30)}


def test_bit_sets_reach_the_driver_without_rows(spark, monkeypatch):
    """(op13) No Python or pandas object per row of the bit sets."""
    found = spark.createDataFrame([(1, 5, None, 2), (1, 6, None, 2), (2, 5, 6, 2)], "length int, c1 long, c2 long, n long")

    def refuse(*_):
        raise AssertionError("rows are collected one by one")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(found), name, refuse)
    sets = phrases.with_bits({1: phrases.no_bits()}, found)
    ones = phrases.slots([np.array([5, 6], np.uint64)])
    twos = phrases.slots([np.array([5], np.uint64), np.array([6], np.uint64)])
    assert sorted(sets) == [1, 2] and phrases.has(sets[1], ones).all() and phrases.has(sets[2], twos).all()
    assert all(int(np.bitwise_count(sets[n]).sum()) == len(np.unique(at)) for n, at in ((1, ones), (2, twos)))
    assert phrases.with_bits({}, found.limit(0)) == {}


def test_weights_move_once_a_round(docs_of, monkeypatch):
    """(op8) The averaged weights go from the tasks that average them to the driver, not through a sort."""
    docs = docs_of([(at, f"some words of text {at}") for at in range(20)]).select("doc_id", "text")
    windows = masked_lm.training_windows(docs, masked_lm.frequent_words(docs), 1)
    plans, collect = [], type(docs).collect

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(docs), "collect", spied)
    weights = masked_lm.train(windows, 1).flat
    averaged = [plan for plan in plans if "average" in plan]
    assert len(averaged) == 1 and averaged[0].count("Exchange ") == 1
    assert weights.shape == masked_lm.WindowNetwork.first().shape and np.isfinite(weights).all()


def test_leaves_are_handed_on_a_few_at_a_time():
    """(pipeline, op7) The pieces of a batch of leaves are never all in memory."""
    code = bpe.coder(bpe.TOKENIZER)
    texts = [f"words of leaf {at} " * 1500 for at in range(120)] + ["日本語 " * 9]
    batch = pd.DataFrame({"row": 1, "doc_id": "a", "part": range(len(texts)), "text": texts})
    frames = list(bpe.encoded_leaves(batch, code))
    assert len(frames) > 2 and max(frame["text"].str.len().sum() for frame in frames) < 1 << 21
    found = pd.concat(frames)
    assert found["part"].tolist() == batch["part"].tolist() and found["text"].tolist() == texts
    assert found["ids"].tolist() == [*map(code.by_library, texts[:-1]), None]


def test_known_pieces_are_bounded_in_memory():
    """(pipeline, op7) However many different pieces a worker meets, and however long they are."""
    code = bpe.Coder(bpe.TOKENIZER)
    long = ["x".join([f"{letter}q" * 3000, f"{letter}z" * 900]) for letter in "abcdefgh"]
    for at in range(0, 300_000, 5000):
        code.encode(" ".join(map(str, range(at, at + 5000))) + f" {long[at % 8]}")
    held = sys.getsizeof(code.known) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in code.known.items())
    assert held < 32_000_000 and max(map(len, code.known)) <= 64
    mixed = f"{long[0]} two words {long[0]} and {long[1]} words {'7' * 64} {'7' * 65}"
    assert code.encode(mixed) == code.encode(mixed) == code.by_library(mixed)


def test_sets_of_a_batch_are_made_a_few_at_a_time():
    """(pipeline, op10) The shingle sets of a batch of texts are never all in memory."""
    texts = [f"words of text {at} " * 2000 for at in range(120)] + [None, "", "one", "a b c d e"]
    batch = pd.DataFrame({"doc_id": [str(at) for at in range(len(texts))], "text": texts}, index=range(7, 7 + len(texts)))
    frames = list(near_duplicates.sketched(batch, 4, WordHashes()))
    assert len(frames) > 2 and max(map(len, frames)) < 60
    found = pd.concat(frames)
    sets = [near_duplicates.shingle_set(text, 4, WordHashes()) for text in texts]
    assert found["doc_id"].tolist() == batch["doc_id"].tolist() and found["n_shingles"].tolist() == [*map(len, sets)]
    assert found["tokens"].tolist() == [near_duplicates.minwise([x])[0].tobytes() if len(x) else None for x in sets]
    keys = [near_duplicates.xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
    assert [a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(found["k1"], found["k2"])] == keys
    assert list(near_duplicates.sketched(batch[:0], 4, WordHashes())) == []


def test_texts_of_no_shared_node_are_not_shuffled(docs_of, no_broadcast, monkeypatch):
    """(op10, pipeline) Texts and members meet the wanted ids in a small set of bits before they move."""
    plans, stored = {}, near_duplicates.stored

    def spied(df, name, *partition_by):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, *partition_by)

    monkeypatch.setattr(near_duplicates, "stored", spied)
    words = "a near copy of a text has nearly all of the words that the other text has in it and one more".split()
    rows = [(1, " ".join(words * 3)), (2, " ".join(words * 3 + ["more"])), *((at, f"{at} own {at * 7} words {at * 3}") for at in range(3, 60))]
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of([*rows, (None, "x")])).collect()}
    assert found == {at: 1 if at == 2 else at for at, _ in rows} | {None: None}
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plans["node_texts"])
    assert "held_nodes" in plans and plans["shared_nodes"].count("FileScan") <= 2


def test_a_set_of_bits_lets_all_wanted_rows_through(spark, no_broadcast):
    """(op10)"""
    table = spark.range(20_000).selectExpr("IF(id < 3, NULL, id) AS id", "'t' AS text").unionByName(spark.sql("SELECT 7L AS id, 'u' AS text"))
    wanted = spark.range(0, 20_000, 100).selectExpr("id AS rep")
    found = near_duplicates.perhaps_among(table, "id", wanted)
    ids = [r.id for r in found.collect()]
    assert found.columns == ["id", "text"] and set(range(100, 20_000, 100)) <= set(ids) and len(ids) < 260
    assert near_duplicates.perhaps_among(table, "id", wanted.limit(0)).count() == 0


def test_words_are_spelt_once_a_core(spark):
    """(op13) More tasks of input are not more tasks that spell the same words."""
    cores = spark.sparkContext.defaultParallelism
    copies = spark.range(0, 400, 1, 10 * cores).selectExpr("'en' AS lang", "'some words, the same in all texts' AS text")
    bits = np.full(1 << phrases.BITS - 6, ~np.uint64(0))
    found = phrases.spelling(copies, phrases.Shared(spark, bits), 0)
    assert f"Coalesce {cores}" in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r.lang, r.word, r.clash, r.n) for r in found.collect()}
    names = {("en", word, False, None) for word in "some words the same in all texts".split()}
    assert rows == names | {("en", None, False, 400 * 7)}


def test_two_words_on_one_code_both_come_out_of_a_task(monkeypatch):
    """(op13) However often and in whatever order a task meets them."""
    plain = phrases.Words.under
    monkeypatch.setattr(phrases.Words, "under", lambda self, seed: np.full(len(self.start), 9, np.uint64) if seed == 0 else plain(self, seed))
    bits = np.full(1 << phrases.BITS - 6, ~np.uint64(0))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["one one two", "two one"]})
    *words, totals = phrases.spelt_words(iter([batch, batch]), bits, 0)
    assert sorted((r["code"], r["word"]) for part in words for r in part.to_pylist()) == [(9, "one"), (9, "two")]
    assert totals.to_pylist() == [{"code": 0, "lang": "en", "word": None, "n": 10}]
