"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import difference
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, SF_DIR, name) is None


def test_driver_contract(spark):
    assert driver.entry(spark).columns == ["query_id", "system", "user"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
