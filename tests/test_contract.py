import contract
import pytest

from rainledger.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, tiny, duck, name):
    contract.same(registry.queries()[name](spark, tiny), duck, registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_runs(spark, tiny, name):
    df = registry.queries()[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
