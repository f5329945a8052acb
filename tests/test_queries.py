import pytest

from mergewright.plans import core

from .conftest import SF


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(name, spark):
    df = core.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned_and_pushed(spark):
    plan = core.QUERIES["row_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate" in plan.replace("l_returnflag:string,l_quantity:double", "l_quantity:double,l_returnflag:string")


def test_top_k_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in core.QUERIES["hard_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
