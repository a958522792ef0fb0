import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of texts, with an extra column of a name that operators use inside."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS + ", spans string")

    return make


@pytest.fixture(scope="session")
def data(spark):
    return DATA
