import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, lang string, doc_id long, size int, key string, words string, items string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text) rows with further columns whose names clash with those of the operators."""
    def make(rows):
        return spark.createDataFrame([(t, None, i, 7, "k", "w", "i", 1) for i, t in rows], SCHEMA)
    return make
