"""The pipeline against its stages' brute-force versions on a small corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelscope.llm import bpe, secret_scan


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijkl"]
    text = lambda n: " ".join(rng.choice(words, n))
    item, copy = text(30), text(120)
    rows = [(at, text(80)) for at in range(20)]
    rows += [(20, "short"), (21, copy), (22, copy), (23, copy + " end"), (24, f"{text(60)} {item} {text(9)}")]
    rows += [(25, f'{text(70)} password = "hunter2hunter2" {text(5)}'), (26, None), (27, "same " * 90)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{20, 26, 27}, {22, 23}, {24}, set()]
    left = set(texts)
    for (_, stage), out in zip(corpus_pipeline.STAGES, gone):
        after = corpus_pipeline.stored(stage(spark, docs, folder), "test")
        left -= out
        assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == left
        docs = after
    changed = docs.where("doc_id = 25").first()
    assert "hunter2" not in changed.text and changed.n_chars == len(changed.text)
    code = bpe.coder(bpe.TOKENIZER)
    clean = {i: secret_scan.redact(texts[i], secret_scan.all_spans(texts[i])[1]) for i in left}
    found = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {i: code.library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
