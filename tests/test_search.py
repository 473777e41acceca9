import pytest
from pyspark.sql import functions as F

from parcelscope.operators import search, segments, substrings

TEXTS = {
    1: "the cat sat on the mat",
    2: "The dog sat; the CAT ran",
    3: "mat on the cat",
    4: "nothing here",
    5: "a-b a b c",
    6: "the the the end",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string")


def brute(query):
    groups = search.parse_search(query)
    found = set()
    for key, text in TEXTS.items():
        padded = f" {' '.join(search.words_of(text))} "
        has = lambda term: (f" {' '.join(term.words)} " in padded) != term.excluded  # noqa: B023, E731
        if any(all(has(term) for term in group) for group in groups):
            found.add(key)
    return found


QUERIES = [
    "cat",
    "cat mat",
    '"the cat"',
    '"on the" cat',
    "cat -dog",
    "-cat",
    "dog or mat",
    "dog or -the",
    '"the the"',
    "a-b",
    '"sat on" or "here"',
    "or cat",
    "cat or",
    "!!!",
    '-"the cat" the',
    "--cat",
]


@pytest.mark.parametrize("query", QUERIES)
def test_column_and_index_agree_with_brute_force(texts, query):
    by_column = {r["id"] for r in texts.where(search.matches_search(F.col("text"), query)).collect()}
    index = search.build_index(texts, "text")
    by_index = [r["id"] for r in search.search_index(index, query, universe=texts).collect()]
    assert by_column == brute(query)
    assert sorted(by_index) == sorted(by_column)


def test_parse():
    parsed = search.parse_search('red "big box" -blue or green')
    assert [[(t.words, t.excluded) for t in group] for group in parsed] == [
        [(("red",), False), (("big", "box"), False), (("blue",), True)],
        [(("green",), False)],
    ]
    assert search.parse_search("or cat") == [[search.Term(("or",), False), search.Term(("cat",), False)]]
    assert search.parse_search("   ") == []


def test_excluded_only_needs_a_universe(texts):
    with pytest.raises(ValueError):
        search.search_index(search.build_index(texts, "text"), "-cat")


def test_stored_index_answers_like_the_column(spark, ships, tmp_path):
    path = str(tmp_path / "index")
    search.write_index(search.build_index(ships), path, 4)
    index = spark.read.parquet(path)
    query = 'nation_3 -"4 not specified" or "supplier 000000007"'
    by_index = {r["id"] for r in search.search_index(index, query).collect()}
    by_column = {r["id"] for r in ships.where(search.matches_search(search.search_text(), query)).collect()}
    assert by_index == by_column and by_index


def test_an_index_of_three_batches_answers_like_one_built_at_once(spark, tmp_path):
    path = str(tmp_path / "grown")
    first = {1: "red box", 2: "blue box", 3: "red cat", 4: "the green hat"}
    second = {5: "red hat", 2: "blue hat", 6: ""}
    third = {3: "green cat", 7: "red box box"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, text string")
    segments.add_segment(frame(first), path, 1, "text", tasks=2)
    for _ in range(2):  # a batch that is written again replaces itself
        segments.add_segment(frame(second), path, 2, "text", tasks=2, removed=frame({2: ""}))
    segments.add_segment(frame(third), path, 5, "text", tasks=2, removed=frame({3: "", 5: ""}))
    whole = {**first, **second, **third}
    del whole[5]
    at_once = search.build_index(frame(whole), "text")
    to = str(tmp_path / "folded")
    segments.fold_segments(spark, path, to, 5, 2)
    segments.add_segment(frame({8: "red box"}), to, 6, "text", tasks=1, removed=frame({7: ""}))
    grown = segments.open_segments(spark, path)
    order = ["token", "id", "pos"]
    assert sorted(map(tuple, grown.select(*order).collect())) == sorted(map(tuple, at_once.select(*order).collect()))
    for query in ("red", "box", "hat", '"red box"', "red -cat", "-red", "green or blue"):
        expected = {r["id"] for r in search.search_index(at_once, query, frame(whole)).collect()}
        assert {r["id"] for r in search.search_index(grown, query, frame(whole)).collect()} == expected
    folded = segments.open_segments(spark, to)
    assert {r["id"] for r in search.search_index(folded, '"red box"').collect()} == {1, 8}


def test_a_search_opens_the_buckets_of_its_words_only(spark, ships, tmp_path):
    path = str(tmp_path / "index")
    search.write_index(search.build_index(ships), path, 4)
    index = spark.read.parquet(path)
    files = index.where(search.bucket_of(F.lit("supplier")) == F.col("bucket")).select("_metadata.file_path").distinct().count()
    plan = search.search_index(index, "supplier")._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "bucket" in filters and files == 1 < len(index.inputFiles())


def test_lookups_by_grams_equal_scans(spark, tmp_path):
    texts = ["SUPPLIER 1", "supplier 1", "a%b_c", "日本語テキスト", "ab", "", None, "xSUPPLIERx", "SUP PLIER", "back\\slash one", "aaaa", "PPLSUPLIER"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    path = str(tmp_path / "grams")
    substrings.add_grams(df.where("id < 6"), path, 2, ("name",))
    substrings.add_grams(df.where("id >= 6"), path, 2, ("name",))
    substrings.add_grams(spark.createDataFrame([(4, "stale text")], df.schema), path, 1, ("name",))
    index = substrings.load_grams(spark, path, ("name",))
    for pattern in ("SUPPLIER", "SUP%IER", "SUP", "本語テ", "ab", "a", "%", "__", "a%b_c", "aaa", "aaaaa", "back\\slash", "stale", "nothing here", "lier_1"):
        scan = {r["id"] for r in substrings.where_contains(df, "name", pattern).collect()}
        assert {r["id"] for r in substrings.where_contains(df, "name", pattern, index).collect()} == scan, pattern
    assert substrings.candidate_keys(index, "name", "ab") is None and substrings.candidate_keys(index, "other", "abc") is None
    assert {r["id"] for r in substrings.candidate_keys(index, "name", "SUP%IER").collect()} == {0, 7, 8, 11}


def _files_of(postings, where):
    """Largest share that one file holds of some postings."""
    rows = postings.where(where).groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
    return max(r["count"] for r in rows) / sum(r["count"] for r in rows)


def test_a_frequent_token_is_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([(at, "the box") for at in range(4000)], "id long, text string")
    segments.add_segment(df, path, 1, "text", tasks=4)
    assert _files_of(spark.read.parquet(f"{path}/postings"), "token = 'the'") < 0.5
    missing = df.withColumn("id", F.when(F.col("id") < 2000, F.col("id"))).withColumn("text", F.concat("text", F.rand(1).cast("string")))
    search.store_index(missing, str(tmp_path / "null_keys"), 4, "text")
    assert _files_of(spark.read.parquet(str(tmp_path / "null_keys")), "token = 'the'") < 0.5
    assert spark.read.parquet(str(tmp_path / "null_keys")).where("token = 'the'").count() == 4000


def test_a_frequent_gram_is_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "grams")
    df = spark.createDataFrame([(at, f"SH{at:06}", "same") for at in range(4000)], "id long, number string, name string")
    substrings.add_grams(df, path, 4, ("number", "name"))
    index = substrings.load_grams(spark, path, ("number", "name"))
    assert _files_of(index.postings, "column = 'name' AND gram = 'sam'") < 0.5
    built = substrings.build_grams(df, ("number", "name"))
    order = ["column", "gram", "id"]
    assert sorted(map(tuple, index.postings.select(*order).collect())) == sorted(map(tuple, built.select(*order).collect()))
    plan = substrings.candidate_keys(index, "number", "0123")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "column" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
