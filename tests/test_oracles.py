import pytest

from tests.oracle import check
from waymark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    check(spark, "/root/testdata/sf0.01", registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
