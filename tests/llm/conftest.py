import os

import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls in every column, blanks, ties, repeated rows, a very long text, special strings.
ROWS = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, "a b", None, None), (4, "A  b\n\n", "de", "s"), (None, "no id", "en", "s"),
    (5, "same text here with some words " * 4, "en", "s"), (6, "same text here with some words " * 4, "en", "s"),
    (6, "same text here with some words " * 4, "en", "s"), (7, "word " * 30_000, "en", "s"), (8, "x" * 50_000, "fr", "s"),
    (9, "\x00 \x0b\x1c <|endoftext|> é😀 ΑΣ", "fr", "s"), (10, "   \n\t\n", "en", "s"), (11, "12345 !!! ???", "es", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names operators use inside.
CLASH = ("h", "n", "top", "code", "node", "score", "label", "key", "n_lines", "n_dropped", "_lost", "_kept", "row", "hash")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def clashing(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        from pyspark.sql import functions as F

        rows = rows.withColumn(c, F.lit("x"))
    return rows


@pytest.fixture
def none(docs):
    return docs.filter("doc_id < 0")


@pytest.fixture
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables are not here")
    return SMALL
