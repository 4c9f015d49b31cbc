"""Every registered query runs; those with SQL match it row by row on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, sf, name):
    ok, message = compare(name, spark, con, entry.queries(), entry.oracle_sql(), sf)
    assert ok, message
