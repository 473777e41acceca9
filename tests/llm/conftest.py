import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with extra columns whose names clash with those of results."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("shard", T.StringType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("node", T.IntegerType()),
        ]
    )

    def make(rows, source="s"):
        full = [(i, t, "en", source, len(t or ""), "k", "x", 1, None) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows and equal texts."""
    long = " ".join(f"word{at % 5000} and" for at in range(60_000))
    plain = "One plain text, that has a few words in it.\nAnd a second line."
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, plain), (6, plain), (6, plain), (None, plain), (None, None), (7, "x")]
