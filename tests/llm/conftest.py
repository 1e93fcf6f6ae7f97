import pytest

from trawl.sources.tables import table


@pytest.fixture(scope="session")
def documents(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]
