import pytest
from pyspark.sql import types as T

LONG = "wort " * 30_000  # one very long text
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nShort line", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "en"),
    (5, LONG, "de"),
    (5, LONG, "de"),
    (6, "Alpha beta gamma delta epsilon zeta eta theta.\nShort line", "en"),
    (None, "Licensed under CC BY-NC 4.0.", None),
    (7, "x", "fr"),
    (8, "é ü １２ naïve words \U0001f600 end", "fr"),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text, ...) rows, with columns whose names clash with those the operators make."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.LongType()),
                           T.StructField("label", T.StringType()), T.StructField("n_words", T.StringType())])

    def make(rows):
        return spark.createDataFrame([(*r, *[None] * (3 - len(r)), "s", "k", 0, "l", "w") for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(TEXTS)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
