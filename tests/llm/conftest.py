import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case: nulls, empty, long, repeated rows, ties, columns of clashing names."""
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(20_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog tonight", "en", "a"), (2, None, "en", "a"), (3, "", "fr", None), (4, " \t\n", None, "b"), (5, long, "en", "b"), (6, long, "en", "b")]
    rows += [(7, "The quick brown fox jumps over the lazy dog tonight", "en", "a"), (7, "The quick brown fox jumps over the lazy dog tonight", "en", "a"), (None, "der hund und die katze", "de", "c"), (8, "😀 ▁ \x00 é", "fr", "c"), (9, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ("n", "th", "ref", "row", "cover", "key", "score", "kept", "words", "host", "node", "pivot", "held_out", "_id", "_hit", "n_chars")
    return df.withColumns({c: F.lit(1).cast("long") for c in clash})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, None), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
