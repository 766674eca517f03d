import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """A DataFrame of documents from (doc_id, text) or longer rows, dealt over a few partitions."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(doc_id, text) of the whole table."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
