"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, ORACLES[name]) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
