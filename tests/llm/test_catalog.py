"""Queries of the subpackage against their SQL."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare
from rareboost.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert ok, note


def test_driver_entry_lists_them():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
