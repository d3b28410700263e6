import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, score double, host string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with further columns whose names operators use themselves."""

    def build(texts, langs=None, sources=None, ids=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [(ids[i], texts[i], (langs or ["en"] * n)[i], (sources or ["src1"] * n)[i], len(texts[i] or ""), "w", 0.5, "h") for i in range(n)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, no words, repeated, long."""
    return [None, "", "  \n ", "\x00é🙂", "same words here", "same words here", "word " * 30_000, "a" * 120_000, "ſecret=K token: abc"]
