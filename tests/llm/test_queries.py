"""The subpackage's queries against their SQL, on the smallest tables."""

import pytest

from siltstone.llm.queries import QUERIES, SQL
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() == df.distinct().count() > 0
