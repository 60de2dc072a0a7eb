"""The registered corpus queries run, and equal their DuckDB SQL where there is one."""

import pytest

from checks.compare import differences, duck
from tablescout.llm import queries

QUERIES = queries.queries()
ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir="/root/testdata/sf0.001"):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, small, name):
    assert differences(spark, con, small, name) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    got = QUERIES[name](spark, small)
    assert len(set(got.columns)) == len(got.columns)
    assert got.count() > 0


@pytest.mark.parametrize("name", ["op3_mix_sources", "op7_line_dedup", "op8_imatch"])
def test_native(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "InPandas", "InArrow", "CartesianProduct"):
        assert unwanted not in plan
