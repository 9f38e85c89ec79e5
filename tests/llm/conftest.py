import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows(spark):
    """A table of documents from (doc_id, text) pairs."""
    return lambda *pairs: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], COLUMNS)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
