import os

import pytest

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    body = " ".join(f"alpha{i} beta{i % 7}" for i in range(40))
    rows = [
        (1, body, "en", "a", len(body), 7, "x"), (2, body + " gamma", "en", "a", 1, 7, "x"), (2, body + " gamma", "en", "a", 1, 7, "x"), (3, None, None, None, None, None, None),
        (None, body, "en", None, 5, 1, "y"), (4, "", "de", "b", 0, 1, "y"), (5, " \n\t ", "de", "b", 4, 1, "y"), (6, long, "en", "c", len(long), 1, "y"), (7, long + " end", "en", "c", 3, 1, "z"),
        (8, "One", "en", "c", 3, 1, "z"), (9, "one", "fr", "c", 3, 1, "z"), (None, None, None, None, None, None, None), (10, "x" * 50_000, "en", "b", 1, 1, "z"), (1, "other text with the same id", "en", "b", 1, 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 int, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
