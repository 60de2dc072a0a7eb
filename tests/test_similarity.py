import random
from collections import defaultdict
from itertools import combinations

import pytest

from tablescout.operators import similarity
from tablescout.options import Options


def catalog_of(spark, columns):
    """One table per column of text values."""
    return {
        f"t{i}": spark.createDataFrame([(v,) for v in values], f"c{i} string").repartition(3)
        for i, values in enumerate(columns)
    }


def random_columns(seed, columns=5, size=400):
    rng = random.Random(seed)
    return [[f"v{int(rng.expovariate(0.01))}" for _ in range(size)] for _ in range(columns)]


def test_thinned_sample_equals_plain_sample(spark):
    catalog = catalog_of(spark, random_columns(1) + [["only"] * 500])
    plain = Options(similarity_sample=40)
    thinned = Options(similarity_sample=40, sample_prefilter_rows=10)
    want = set(map(tuple, similarity.value_sample(catalog, plain).collect()))
    got = set(map(tuple, similarity.value_sample(catalog, thinned).collect()))
    assert got == want and len(want) == 5 * 40 + 1


def test_short_samples_are_drawn_again(spark, monkeypatch):
    catalog = catalog_of(spark, random_columns(2, 3))
    want = set(map(tuple, similarity.value_sample(catalog, Options(similarity_sample=40)).collect()))
    monkeypatch.setattr(similarity, "_hash_limit", lambda distinct, wanted: "08000000")
    thinned = Options(similarity_sample=40, sample_prefilter_rows=10)
    assert set(map(tuple, similarity.value_sample(catalog, thinned).collect())) == want


def test_overlap_and_jaccard_against_sets(spark):
    columns = random_columns(3) + [["nowhere"], [None]]
    catalog = catalog_of(spark, columns)
    sets = [{v for v in values if v is not None} for values in columns]
    want = {
        (f"t{i}", f"t{j}"): len(sets[i] & sets[j])
        for i, j in combinations(range(len(sets)), 2)
        if sets[i] & sets[j]
    }
    overlap = similarity.value_overlap(catalog).collect()
    assert {(r["table_name_1"], r["table_name_2"]): r["common"] for r in overlap} == want
    rows = similarity.jaccard(catalog).collect()
    assert len(rows) == 21
    for r in rows:
        a, b = sets[int(r["table_name_1"][1:])], sets[int(r["table_name_2"][1:])]
        expected = 100 * len(a & b) / len(a | b) if a and b else 0.0
        assert r["value_percent"] == pytest.approx(expected, abs=0.051)


def test_columns_of_one_table_are_not_paired(spark):
    df = spark.createDataFrame([("a", "a")], "x string, y string")
    other = spark.createDataFrame([("a",)], "z string")
    rows = similarity.column_pairs({"one": df, "two": other}).collect()
    assert {(r["column_name_1"], r["column_name_2"]) for r in rows} == {("x", "z"), ("y", "z")}
    assert similarity.column_pairs({"one": df}).count() == 0
    assert similarity.column_similarity({"one": df}).count() == 0


def verdicts(spark, name_1, values_1, name_2, values_2):
    catalog = {
        "a": spark.createDataFrame([(v,) for v in values_1], f"`{name_1}` string"),
        "b": spark.createDataFrame([(v,) for v in values_2], f"`{name_2}` string"),
    }
    rows = similarity.column_similarity(catalog).collect()
    return [(r["match_percent"], r["likely_relationship"]) for r in rows]


def test_verdicts_at_their_limits(spark):
    # names without a common letter leave 0.6 x the better of values and shapes
    assert verdicts(spark, "p", ["a1", "c"], "q", ["c"]) == [(30.0, "weak match")]
    assert verdicts(spark, "p", ["1a", "2b"], "q", ["1a", "x-9"]) == [(30.0, "weak match")]
    assert verdicts(spark, "p", ["a1", "c", "+"], "q", ["c"]) == []
    assert verdicts(spark, "p", ["ab1"], "q", ["+"]) == []
    assert verdicts(spark, "p", ["k1"], "q", ["k1"]) == [(60.0, "worth reviewing")]
    assert verdicts(spark, "id", ["k1"], "id", ["k1"]) == [(100.0, "possible key / FK match")]
    assert verdicts(spark, "id", ["k1"], "id", ["m7"]) == [
        (100.0, "same format/pattern, values differ - verify")
    ]
    assert verdicts(spark, "id", ["+"], "id", ["-"]) == [(40.0, "weak match")]


def test_a_value_in_every_column_is_counted_once_per_pair(spark):
    catalog = catalog_of(spark, [["hot"] * 300 + [f"{i}-{j}" for j in range(20)] for i in range(12)])
    rows = similarity.value_overlap(catalog).collect()
    counts = defaultdict(int)
    for r in rows:
        counts[r["common"]] += 1
    assert counts == {1: 66}


def test_decimals_and_large_doubles_meet_integers(spark):
    whole = spark.range(20).selectExpr("id as a", "9007199254740000 + id as b")
    other = spark.range(20).selectExpr(
        "cast(id as decimal(12,2)) as a", "cast(9007199254740000 + id as double) as b", "cast(id + 0.50 as decimal(12,2)) as c"
    )
    rows = {
        (r["column_1"], r["column_2"]): r["value_similarity"]
        for r in similarity.column_similarity({"t": whole, "u": other}).collect()
    }
    assert rows["a", "a"] == 100.0 and rows["b", "b"] == 100.0
    assert rows.get(("a", "c"), 0.0) == 0.0
