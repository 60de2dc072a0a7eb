import random

import numpy as np
import pytest

from tablescout.operators.columns import numeric_fields
from tablescout.operators.quantiles import column_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check(spark, columns, partitions):
    names = ", ".join(f"c{i} double" for i in range(len(columns)))
    df = spark.createDataFrame(list(zip(*columns)), names).repartition(partitions)
    found = column_quantiles(df, numeric_fields(df), PROBS)
    for (n, values), column in zip((found[i + 1] for i in range(len(columns))), columns):
        present = [v for v in column if v is not None]
        assert n == len(present)
        if not present:
            assert values == [None] * len(PROBS)
        else:
            assert values == pytest.approx(list(np.quantile(present, PROBS)), rel=1e-12)


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_numpy(spark, partitions):
    rng = random.Random(3)
    size = 3001
    uniform = [rng.random() for _ in range(size)]
    heavy = [5.0 if rng.random() < 0.34 else rng.gauss(5, 1) for _ in range(size)]
    two = [float(rng.choice((1, 2))) for _ in range(size)]
    gaps = [None if rng.random() < 0.5 else rng.expovariate(1) for _ in range(size)]
    wide = [rng.choice((-1, 1)) * 10 ** rng.uniform(-5, 15) for _ in range(size)]
    none = [None] * size
    nans = [float("nan") if i % 3 == 0 else float(i) for i in range(size)]
    check(spark, [uniform, heavy, two, gaps, wide, none], partitions)
    df = spark.createDataFrame([(v,) for v in nans], "c0 double")
    n, values = column_quantiles(df, numeric_fields(df), [0.5])[1]
    kept = [v for v in nans if v == v]
    assert (n, values) == (len(kept), [float(np.median(kept))])


def test_single_value_and_empty(spark):
    df = spark.createDataFrame([(1.5,)], "c0 double")
    assert column_quantiles(df, numeric_fields(df), [0.25, 0.75]) == {1: (1, [1.5, 1.5])}
    empty = df.where("c0 > 2")
    assert column_quantiles(empty, numeric_fields(empty), [0.25]) == {1: (0, [None])}


def test_approximate_is_close(spark):
    df = spark.range(10_000).selectExpr("double(id) as c0")
    n, (q,) = column_quantiles(df, numeric_fields(df), [0.5], method="approximate")[1]
    assert n == 10_000 and abs(q - 5000) <= 2
    with pytest.raises(ValueError):
        column_quantiles(df, numeric_fields(df), [0.5], method="guess")


def test_many_scans(spark, monkeypatch):
    """Spans of two parts and no short cut: every bit costs a scan, the values stay the same."""
    from tablescout.operators import quantiles

    monkeypatch.setattr(quantiles, "STEPS", 2)
    monkeypatch.setattr(quantiles, "FEW", 0)
    rng = random.Random(5)
    check(spark, [[rng.gauss(0, 3) for _ in range(60)], [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324] * 10], 3)


def test_plan_moves_counts_only(spark, monkeypatch):
    from tablescout.operators import quantiles

    seen = []
    real = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: seen.append(a) or real(*a))
    df = spark.range(100_000).selectExpr("double(id % 90001) * 0.37 as c0", "double(id) as c1")
    found = column_quantiles(df, numeric_fields(df), [0.25, 0.5])
    assert len(seen) <= 3
    values = sorted((i % 90001) * 0.37 for i in range(100_000))
    assert found[1][1] == pytest.approx(list(np.quantile(values, [0.25, 0.5])), rel=1e-12)
