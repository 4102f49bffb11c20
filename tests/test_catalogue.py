"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from barloom.registry import catalogue
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalogue()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    query = QUERIES[name]
    result = query.run(spark, SF_DIR)
    if query.sql is None:
        assert len(result.schema.fields) > 0 and result.count() >= 0
        return
    problem = compare(result, con, query.sql)
    assert problem is None, problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
