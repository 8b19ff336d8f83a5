"""Every registered query runs at the smallest scale; those with a SQL twin must agree value by value."""

import os

import pytest
from oracle import compare, connect

from groveflow.plans import QUERIES, SQL

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables not present")


@pytest.fixture
def con():
    """A connection of its own for every test: a failure stays with its query."""
    with connect(PATH) as con:
        con.execute("SET threads=2; SET memory_limit='2GB'")
        yield con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, QUERIES[name], SQL.get(name), PATH)
    assert not result.startswith("FAIL"), result


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
