"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from harness import difference, duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLE:
        assert difference(got, duck_rows(con, ORACLE[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLE) <= set(QUERIES)
