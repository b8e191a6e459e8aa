import pytest

from florilege.queries import registry
from florilege.session import staging
from oracle import same

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    with staging(spark):
        same(spark, small, registry.queries()[name], ORACLES[name])


#: Queries without SQL: each is tested against brute force elsewhere.
NO_SQL = {"p4_rejected", "table_signature", "document_fields", "derived_profile", "normalized_traits"}


def test_only_these_queries_have_no_sql():
    assert set(registry.queries()) - set(ORACLES) == NO_SQL


def test_every_query_has_a_name_and_sql_belongs_to_one():
    queries, oracles = registry.queries(), registry.oracles()
    assert len(queries) > 100
    assert set(oracles) <= set(queries)


def test_entry_runs_without_the_llm_package(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
