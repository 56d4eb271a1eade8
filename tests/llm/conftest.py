import pytest

from faultline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls in every column, blank and one-word texts, repeated rows, a long text, and columns that clash with results."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None, 7, "x"), (2, "", None, None, 0, 7, "x"), (3, " \t\n", "fr", "a", 3, 7, "x"), (4, "word", "en", "a", 4, 7, "x"), (4, "word", "en", "a", 4, 7, "x"),
        (None, "one two three four five six seven", "en", None, 10, 7, "x"), (5, "1234 !!", "en", "b", 7, 7, "x"), (6, long, "en", "b", len(long), 7, "x"), (7, long + " end", None, "b", None, 7, "x"), (8, "Ünïcode naïve ", "de", "c", 14, 7, "x"),
    ]
    return spark.createDataFrame(rows, DOCS + ", n_tokens int, score string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
