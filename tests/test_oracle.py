"""Every registered query runs; where it has SQL the results are equal row by row."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.check import compare, duck

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, info = compare(spark, con, SF_DIR, queries()[name], oracle_sql().get(name))
    assert ok, info


def test_entry(spark):
    assert entry(spark).count() > 0
