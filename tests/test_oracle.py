"""Every registered query against its independent SQL."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query(spark, con, key):
    wrong, rows = difference(entry.queries()[key](spark, SF), con, entry.oracle_sql()[key])
    assert wrong is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
