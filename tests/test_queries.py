"""Every registered query against its SQL on the small driver tables."""

from pathlib import Path

import pytest

from checks.compare import difference, oracle_connection
from checks.oracles import ORACLES
from checks.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).is_dir(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, connection, name):
    assert difference(spark, connection, DIRECTORY, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 10
    assert contract.queries().keys() >= contract.oracle_sql().keys()
