import pytest

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, lang, source) rows."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids."""
    long = "word other third " * 8000
    return make_docs([
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "some words here", "de", None),
        (4, long, "en", "b"), (4, long, "en", "b"), (5, "same text of five words", "en", "b"),
        (6, "same text of five words", None, "a"), (6, "another text", "en", "b"), (None, None, None, None),
        (7, "x" * 50_000, "en", "b"), (8, "Ein schöner Tag, größer als gestern 😀!", "de", "c")])


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
