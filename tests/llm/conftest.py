import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum " * 60_000

#: Rows with nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns that clash with the operators' own.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnother line here with some more words in it, as it happens.", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog.\nAnother line here with some more words in it, as it happens.", "a", 2),
    (2, "the QUICK brown fox jumps over the lazy dog.\nAnother line here with some more words in it, as it happens.", "a", 3),
    (3, None, "b", 4),
    (4, "", None, 5),
    (5, " \t\n ", "b", 6),
    (None, "All rights reserved. Licensed under CC BY-NC 4.0. ß 中文 😀 'tis <|endoftext|>", "c", None),
    (None, None, None, None),
    (6, LONG, "c", 7),
    (7, "x" * 50_000, "c", 8),
]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({c: F.lit(0) for c in ("hash", "h", "fp", "n_words", "score", "kept", "place", "rank", "host", "removed", "n", "length", "item_id", "sequence_id", "votes")})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """The smallest table's ids and texts, in the driver."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
