import pytest

from florilege.llm.queries import ORACLES, QUERIES
from oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    same(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    QUERIES[name](spark, small).count()
