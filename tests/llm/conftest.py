import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import EDGES  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark, small):
    """The smallest documents as (doc_id, text) rows."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def frame(spark):
    """A function from (doc_id, text) rows to a table that has columns with clashing names."""

    def make(rows):
        schema = "doc_id long, text string, doc string, spans string, bucket int, label string, kept string, component long, score double, hash long"
        return spark.createDataFrame([(*r, None, "s", 1, "l", "k", 7, 0.5, 3) for r in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def mixed(documents):
    return documents + EDGES
