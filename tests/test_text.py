import random
import string
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout.functions import text

SETTINGS = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def results(df, expression):
    return [r["r"] for r in df.select("i", expression.alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("value", "two_pass", "run_length"),
    [
        ("abc123", "LD4", "L3D3"),
        ("ab-9981", "LD1-D4", "L2-D4"),
        ("a1b22", "LD2LD3", "L1D1L1D2"),
        ("abcdefghijkl", "LD2", "L12"),
        ("", "", ""),
        ("--", "--", "--"),
    ],
)
def test_value_shape(spark, value, two_pass, run_length):
    df = column(spark, [value])
    assert results(df, text.value_shape(F.col("v"), "run_length")) == [run_length]
    assert results(df, text.value_shape(F.col("v"))) == [two_pass]


@SETTINGS
@given(st.lists(st.text(alphabet="abZ019-_ é", max_size=12), min_size=1, max_size=40))
def test_shape_marks_runs_twice(spark, values):
    def marked(value, inside, mark):
        runs = [(known, list(run)) for known, run in groupby(value, lambda c: c in inside)]
        return "".join(f"{mark}{len(run)}" if known else "".join(run) for known, run in runs)

    expected = [marked(marked(v, string.ascii_letters, "L"), string.digits, "D") for v in values]
    assert results(column(spark, values), text.value_shape(F.col("v"))) == expected


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 100.0 if not a + b else 200.0 * common(a, b) / (len(a) + len(b))


def test_name_similarity_against_brute_force(spark):
    rng = random.Random(7)
    letters = string.ascii_lowercase[:6] + "_ "
    names = [("", ""), ("a", ""), ("x" * 61, "x" * 70), ("ab" * 40, "ba" * 35), ("l_orderkey", "o_orderkey")]
    for _ in range(200):
        names.append(tuple("".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(2)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "i int, a string, b string")
    got = results(df, text.name_similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([ratio(a, b) for a, b in names])
    turned = results(df, text.name_similarity(F.col("b"), F.col("a")))
    assert turned == pytest.approx(got)


def test_token_order_does_not_matter(spark):
    df = spark.createDataFrame([(0, "first name", "name first")], "i int, a string, b string")
    assert results(df, text.name_similarity(F.col("a"), F.col("b"))) == [100.0]


def test_numbers_as_text(spark):
    yes = ["1", " 1 ", "-2.5", "+3", ".5", "5.", "1e5", "1E-3", "inf", "-Infinity"]
    no = ["", " ", "1d", "1f", "nan", "1,5", "0x1", "--1", "e5", "1 2", "."]
    got = results(column(spark, yes + no), F.col("v").rlike(text.NUMBER_TEXT))
    assert got == [True] * len(yes) + [False] * len(no)


def test_display_number(spark):
    values = [1.0, 0.1, 12345678.9, 1e7, 123456789012345.0, 1.5e15, 0.00012, 0.05, -2.5e8, 1e16, 1e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = results(df, text.display_number(F.col("v")))
    assert got[:9] == [str(v) for v in values[:9]]
    assert got[9:] == ["1.0E16", "1.0E-7"]


def test_match_text_meets_integer_keys(spark):
    df = spark.createDataFrame([(0, 1.0, 7.25, " Ab ")], "i int, d double, e double, s string")
    assert results(df, text.match_text(F.col("d"), "double")) == ["1"]
    assert results(df, text.match_text(F.col("e"), "double")) == ["7.25"]
    assert results(df, text.match_text(F.col("s"), "string")) == ["ab"]
