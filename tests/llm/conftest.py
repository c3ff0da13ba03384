import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor " * 20_000
    return [
        (1, "alpha beta gamma delta epsilon. Zeta\neta theta", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here", "en", "a", 10), (4, long, "en", "b", len(long)),
        (5, "same text here again", "en", "c", 5), (6, "same text here again", "en", "c", 5), (6, "same text here again", "en", "c", 5), (7, "  \t\n \v", "en", "c", 5), (8, "é" * 3000 + " 日本語 \U0001f600", "xx", "d", 1), (9, "x" * 5000, "en", None, 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "doc_id as size", "lang as sequence_id", "source as held_out", "n_chars as fp", "text as word").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(7)
