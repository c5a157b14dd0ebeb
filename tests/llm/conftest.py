import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null text, empty, blank, one word, a repeated row, equal texts, a very long text, signs only, and a null id.
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "One", "en", "a", 3),
    (5, "the same little text about nothing at all", "en", "b", 41),
    (5, "the same little text about nothing at all", "en", "b", 41),
    (6, "The same little text about NOTHING at all", "en", "b", 41),
    (7, "word " * 40_000, "en", "b", 200_000),
    (8, "*** ### 12 !!", "de", None, 13),
    (9, "über élan niño 日本 \U0001f600", "de", "c", 20),
    (None, "a text without an id", "fr", "c", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents at the edges of what a table can hold, with columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in ("id", "fp", "row", "score", "start", "length", "list", "word", "n", "key")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
