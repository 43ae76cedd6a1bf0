import pytest

from partgraph.llm.common import Scratch, tune


@pytest.fixture(scope="session")
def llm(spark):
    return tune(spark)


@pytest.fixture
def scratch(llm):
    return Scratch(llm, "test")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(llm):
    """A table of documents from (id, text) rows, with two columns no operator knows."""

    def make(rows):
        full = [(i, t, None, "s", None if t is None else len(t), "x", 1) for i, t in rows]
        return llm.createDataFrame(full, DOCS + ", hash string, tie int")

    return make
