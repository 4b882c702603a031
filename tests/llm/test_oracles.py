"""Registered queries with SQL give DuckDB's rows; all others give one row for each document."""

import compare
import pytest

from lodestar.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    names, got = compare.rows_of_spark(queries.QUERIES[name](spark, SF))
    want_names, want = compare.rows_of_sql(compare.duck(SF), queries.ORACLES[name])
    assert names == want_names and got == want


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
