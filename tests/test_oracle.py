"""Every query with an oracle, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, connection, name):
    equal, rows, message = compare(spark, connection, entry.queries()[name], ORACLE[name], SF_DIR)
    assert equal, message
    assert rows > 0 or name == "items_over_points"  # no footprint holds a point in the smallest tables


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
