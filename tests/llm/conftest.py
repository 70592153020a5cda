import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with columns whose names clash with those that operators use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows]
        return spark.createDataFrame(full, ROWS + ", row string, chunk int")

    return make
