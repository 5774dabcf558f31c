import os

import pytest

import __spark_entry__ as registered
from compare import connect, difference
from corpusmith import catalog, oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.QUERIES)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["query_id", "rank", "vec_id", "distance"]
    assert df.count() == 5 * 500


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(registered.queries()[name](spark, SF_DIR), con, SQL[name]) is None
