"""Every registered query runs, and equals its DuckDB SQL where there is one."""

import pytest

import __spark_entry__
from checks.compare import differences, duck
from checks.oracles import oracle_sql
from checks.queries import queries

# those of the corpus package have tests of their own
QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir="/root/testdata/sf0.001"):
    return duck(small_dir)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 14
    assert {r["data_type"] for r in rows} == {"integer", "text", "decimal", "date/time"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, small, name):
    assert differences(spark, con, small, name) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
