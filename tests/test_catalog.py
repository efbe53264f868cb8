"""Every catalog query with a SQL text returns the rows DuckDB returns for that text."""

import pytest

from check_oracles import compare
from rareboost.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
