"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "day", "final", "total"] and df.count() == 1500


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) is None
