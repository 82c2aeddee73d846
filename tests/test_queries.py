"""Every registered query against its SQL statement at the smallest scale."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert compare(got, con.sql(sql).to_arrow_table()) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "f" in out.columns
