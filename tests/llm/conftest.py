import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, digest string, words long, score string"


@pytest.fixture
def documents(spark):
    """documents((id, text) or (id, text, lang, source), ...) with columns of clashing names besides."""

    def make(*rows):
        full = [(*r, *[None] * (4 - len(r)), None, 1, "k", "d", 2, "s") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(documents):
    """Null ids, texts and sources, empty and blank texts, marks only, repeated rows and ids, a very long text."""
    return documents(
        (None, None), (None, "lonely text without an id here", "en", None), (1, ""), (2, " \n\t "), (3, "!!! ???", "en", "b"), (4, "one", "en", "a"),
        (5, "same row twice over", "en", "a"), (5, "same row twice over", "en", "a"), (6, "same id", None, "a"), (6, "other text", None, "b"),
        (7, "word and another one " * 40_000, "en", "c"),
    )
