"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from bindings.check import compare, connect

ROOT = "/root/testdata/sf0.001"
# No rows at this size: the filter of the query keeps nothing.
MAY_BE_EMPTY = {"q20_delay_distribution", "p12_p13_p14_p15_filters", "q02_customer_query_sample"}


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, ROOT).count() > 0
        return
    problem = compare(spark, ROOT, duck, fn, sql)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        problem = None
    assert problem is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["country_name", "product_tier", "in_arrears", "total",
                              "arrears_rate_pct"]
    assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
