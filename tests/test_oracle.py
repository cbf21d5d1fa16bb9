"""Every registered query with SQL gives the same rows as DuckDB."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# checked against brute force or numpy in the other tests
UNCHECKED = set(entry.queries()) - set(SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_names_agree():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    _, problem = compare(spark, con, SF_DIR, entry.queries()[name], SQL[name])
    assert problem is None


@pytest.mark.parametrize("name", ["profile_samples", "recommend_cleaning", "recommend_fe", "file_hash"])
def test_runs(spark, name):
    assert name in UNCHECKED and entry.queries()[name](spark, SF_DIR).count() > 0
