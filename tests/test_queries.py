import pytest

import __spark_entry__ as driver
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def library_queries():
    """Those with SQL; the rest, and those of subpackages that may be absent, are tested with their operators."""
    return sorted(name for name in driver.oracle_sql() if name in driver.QUERIES)


@pytest.mark.parametrize("name", library_queries())
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) == []


def test_entry(spark):
    assert driver.entry(spark).count() > 0
