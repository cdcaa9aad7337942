import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with the other columns and one that clashes with an internal name."""

    def make(*rows, **extra):
        data = [(i, t, extra.get("lang", "en"), extra.get("source", "s"), len(t) if t is not None else None, "x") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, hits string")

    return make
