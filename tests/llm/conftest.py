import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from texts; ids count from 0."""

    def make(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
