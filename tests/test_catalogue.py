"""Every registered query that has SQL gives the rows that DuckDB gives."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") or not k[2:3].isdigit()))
def test_same_rows(spark, con, name):
    names, got = compare.rows_of_spark(entry.queries()[name](spark, SF))
    want_names, want = compare.rows_of_sql(con, entry.oracle_sql()[name])
    assert names == want_names
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6
