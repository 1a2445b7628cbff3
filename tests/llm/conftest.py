import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents, with nulls in any column and an extra column that clashes with operators' names."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, COLUMNS + ", component_id string")

    return make
