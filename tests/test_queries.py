"""Every registered query beside its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from rowloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, con.sql(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
