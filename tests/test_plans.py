"""Physical plans: what must and must not be in them."""

import re

import pytest

from checks.queries import queries
from tablescout.operators import describe, keys, similarity
from tablescout.operators.columns import value_counts

QUERIES = queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_row_python_and_no_cross_join(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    for unwanted in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "NestedLoopJoin", "CartesianProduct"):
        assert unwanted not in plan


def test_value_counts_collapse_before_the_shuffle(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    plan = plan_of(value_counts(orders))
    assert plan.count("partial_count(1)") == plan.count("Exchange hashpartitioning") == 4
    # every family reads its own columns only
    assert "ReadSchema: struct<o_totalprice:double>" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_sample_and_modes_are_cut_before_they_move(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    values = similarity._match_values(orders, similarity._catalog_columns({"orders": orders}), {})
    plan = plan_of(similarity._smallest_by_hash(values, 500))
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    df = describe.table_modes(orders)
    df.collect()
    plan = plan_of(df)
    assert re.search(r"WindowGroupLimit .*Partial", plan) and "ReusedExchange" in plan


def test_duplicates_collapse_before_the_shuffle(spark, small):
    plan = plan_of(keys.table_duplicates(spark.read.parquet(f"{small}/nation.parquet")))
    assert "partial_count(1)" in plan
