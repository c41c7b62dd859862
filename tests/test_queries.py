"""Every registered query against its checking SQL, on the small tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import checking_database, database_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return checking_database(SF_DIR)


# Queries of the optional operators, which have tests of their own.
OPTIONAL = {name for name in QUERIES if re.match(r"op\d+_|pipeline$", name)}


def test_every_query_has_checking_sql():
    assert set(QUERIES) - OPTIONAL == set(SQL) - OPTIONAL


@pytest.mark.parametrize("name", [n for n in SQL if n not in OPTIONAL])
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns, rows = spark_rows(frame)
    expected_columns, expected = database_rows(database, SQL[name])
    assert rows, "the query should find something"
    assert columns == expected_columns
    assert rows == expected
