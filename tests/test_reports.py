"""Every listed query against its SQL on the small tables."""

import pytest

from rowloom.reports import QUERIES, SQL
from tests.oracle import compare, database


@pytest.fixture(scope="module")
def con(data):
    return database(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, con, name):
    problem = compare(QUERIES[name](spark, data), con, SQL[name])
    if problem == "both sides are empty":
        pytest.skip("no rows at this size")
    assert problem is None, problem


def test_entry_points():
    import __spark_entry__ as e

    assert e.queries().keys() >= QUERIES.keys()
    assert e.oracle_sql().items() >= SQL.items()
