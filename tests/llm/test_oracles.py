import pytest

from tests.oracle import check
from waymark.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    check(spark, "/root/testdata/sf0.01", queries.queries()[name], sql.oracle_sql()[name])
