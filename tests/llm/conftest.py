import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int, score double, rank int, n long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, source) as documents with columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 1, 0.5, 3, 9) for i, t, s in rows], SCHEMA)

    return make


ODD = [
    (None, "a row without an id", "s1"), (1, None, None), (2, "", "s1"), (3, "   \n\t ", "s1"), (4, "one", None), (4, "one", None),
    (5, "word " * 30_000, "s2"), (6, "x" * 100_000, "s2"), (7, "É ß 漢字 \U0001f600 " * 5, ""), (8, "token = \"abcdef123456\" and more", "s2"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def empty(documents, spark):
    return spark.createDataFrame([], SCHEMA)
