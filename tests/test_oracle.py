"""Every registered query against its SQL."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from millrace.queries import BUILDS, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(BUILDS))
def test_query(spark, con, name):
    assert compare(con, SQL[name], BUILDS[name](spark, SF_DIR)) is None


def test_every_query_has_sql():
    assert set(BUILDS) == set(SQL)
    assert set(BUILDS) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["word", "word_count"]
    assert df.count() == 1
