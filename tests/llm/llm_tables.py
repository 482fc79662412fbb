"""A documents table for the tests of this folder."""
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table; rows may leave out trailing columns."""
    def build(rows):
        full = [(r + (None,) * 5)[:5] for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)
    return build
