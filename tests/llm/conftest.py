import pytest

from fleetlens.session import cut_lineage, scratch  # noqa: F401

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (id, text) pairs, other columns null."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)

    return make
