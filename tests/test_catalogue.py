"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest
from compare import differences

import __spark_entry__ as contract
import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, FOLDER, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns[4] == "quantity"


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
