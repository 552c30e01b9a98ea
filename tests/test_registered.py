"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import database, difference
from checks.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    rows, problem = difference(df, con, entry_points.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["qid", "rn", "id", "dist"]
