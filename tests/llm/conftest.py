import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and columns that clash."""
    rows = [
        (None, "some words without a key here", "en", "a", 1), (1, None, "en", None, 2), (2, "", None, "a", 3),
        (3, " \t\n", "en", "b", 4), (4, "One two three four five six seven eight nine ten eleven twelve", None, None, 5),
        (4, "One two three four five six seven eight nine ten eleven twelve", None, None, 5),
        (5, "one TWO three four five six seven eight nine ten eleven twelve", "de", "b", 6),
        (6, "word " * 30_000, "en", "a", 7), (7, "x", "en", "", 8), (8, "日本語 😀 ünïcode \u0000 text", "ja", "b", None),
        (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "h", "fp", "n", "v", "size", "shard", "depth", "score", "n_tokens", "host", "spans", "words", "block"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
