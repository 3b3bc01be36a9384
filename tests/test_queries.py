"""Every registered query beside its SQL on the small tables."""

import pytest

from __spark_entry__ import entry
from check import compare, connect
from paperloom.plans import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).columns == ["source", "type", "count", "masked"]
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note
