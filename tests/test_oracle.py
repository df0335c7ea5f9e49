"""Every query of the library that has SQL gives the same rows as it, on the smallest tables."""

import oracle
import pytest

from litforge.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    oracle.same(QUERIES[name](spark, oracle.FOLDER), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, oracle.FOLDER).count() > 0
