"""Every catalogue query against its SQL twin; queries without one must yield rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert compare(spark, con, sf, name, queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_yields_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 6


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(queries())
