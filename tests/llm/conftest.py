import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(pairs, **more):
        rows = [(i, t, "en", more.get("source", "src0"), None if t is None else len(t), "x", "y", 1) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, node string, score int")

    return make


@pytest.fixture
def by_id():
    return lambda df: {r.doc_id: r for r in df.collect()}
