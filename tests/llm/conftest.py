import pytest
from pyspark.sql import functions as F

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over a lazy dog while many small birds watch from the old stone wall near our river"
CLASHING = "key nth row node center bucket unit part start length size taken label head lent number block x y id payload".split()


def odd_rows():
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, "", "en", "a"), (2, None, None, None), (3, "one two", "en", None), (4, long_text, "en", "b"), (5, BASE, "en", "a"), (6, BASE, "en", "a"),
        (6, BASE, "en", "a"), (7, BASE + " and then some more", None, "b"), (8, "▁ <s> <|endoftext|> é日本 \u0000 \t\n\n x  y", "fr", ""), (9, " \n\t ", "en", "b"),
        (10, "Released under the MIT License.\n" + BASE.upper(), "en", "a"), (None, "no id " + BASE, "en", "a"), (None, None, None, None),
        (11, "ab" * 5000, "en", "c"), (12, "De " * 400, "en", "c"), (13, "x" * 70_000, "en", "c"), (14, "x" * 69_999 + "y", "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long, repeated and tied rows, with columns named like the operators' own."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in odd_rows()]
    docs = spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHING]).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, None, 1), (None, 1, 1), (5, 0, 1), (5, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) in ascending order."""
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
