"""Every registered query against its SQL, and the driver's entry points."""

import pytest
from compare import compare
from conftest import SF

import __spark_entry__ as driver
from tidewheel import plans


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    rows, wrong = compare(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)
    assert wrong is None
    assert rows > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert plans.QUERIES.keys() == plans.ORACLES.keys() <= driver.queries().keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()
