"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    why, _ = compare(entry.queries()[name](spark, FOLDER), duck, SQL[name])
    assert why is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
