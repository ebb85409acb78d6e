"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry
import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    msg, ok = compare.compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
