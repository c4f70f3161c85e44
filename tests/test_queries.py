"""Registered queries against their reference SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from agentguard.plans import REGISTRY
from tests.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_flagship_runs(spark):
    assert entry(spark).count() > 0


def test_reference_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@needs_data
@pytest.mark.parametrize("name", sorted(n for n, query in REGISTRY.items() if query.sql))
def test_query_matches_reference(spark, name):
    got, want, diff = compare(queries()[name](spark, SF), oracle_connection(SF), oracle_sql()[name])
    assert not diff, (got, want, diff[:3])
