import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with ours."""
    rows = [
        (1, "the first text of some words", "en", "a"), (1, "the first text of some words", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "word " * 3000, "en", None),
        (5, "the first text of some words", "de", "b"), (6, "   \n\t ", "de", "b"), (None, "a text without an id", "fr", "c"), (8, "été à la plage, 4111 1111 1111 1111", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("size", "rank", "id", "fp", "part", "target", "n", "key", "score")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
