import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words long, score double, spans string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id, astral characters, and columns with clashing names."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "word " * 30_000, "en", "a"), (4, "the quick brown fox jumps over the lazy dog again and again", "en", "b"), (4, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
        (5, "😀 ünïcödé   x", "fr", None), (None, "a text without an id that has some words in it", "en", "b"), (6, "12345 !!! ...", None, "c"), (7, "one\ntwo\none\ntwo\n\n", "de", "c"), (7, "another text under the same id", "de", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "x", 7, 0.5, "y") for i, t, la, s in rows], DDL)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DDL)
