import random

import pytest
from pyspark.sql import functions as F

from tablescout.operators import clusters


def silhouette(points):
    """Mean over all pairs of (value, cluster), by the definition."""
    groups = {}
    for v, c in points:
        groups.setdefault(c, []).append(v)
    total = 0.0
    for v, c in points:
        own = groups[c]
        if len(own) == 1:
            continue
        a = sum(abs(v - u) for u in own) / (len(own) - 1)
        b = min(sum(abs(v - u) for u in g) / len(g) for k, g in groups.items() if k != c)
        total += (b - a) / max(a, b) if max(a, b) else 0.0
    return total / len(points)


def intervals(rng, k, size, offset):
    values = sorted(offset + round(rng.gauss(0, 1) + 4 * rng.randrange(k), 1) for _ in range(size))
    cuts = sorted(rng.sample(range(1, size), k - 1))
    return [(v, sum(values[c - 1] < v for c in cuts)) for v in values]


def test_silhouette_against_brute_force(spark):
    rng = random.Random(5)
    cases = [intervals(rng, 2 + i % 4, 60, 1e6 * i) for i in range(8)]
    cases.append([(1.0, 0), (2.0, 0), (50.0, 1)])
    cases = [c for c in cases if len({k for _, k in c}) > 1]
    rows = [(i, 0, v, c) for i, case in enumerate(cases) for v, c in case]
    values = (
        spark.createDataFrame(rows, "pos int, k int, v double, cluster int")
        .groupBy("pos", "k", "v", "cluster")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    got = {r["pos"]: r["silhouette"] for r in clusters.silhouette_1d(values).collect()}
    assert got == pytest.approx({i: silhouette(c) for i, c in enumerate(cases)}, abs=1e-9)


def test_one_cluster_has_no_score(spark):
    values = spark.createDataFrame([(1, 2, 1.0, 3, 0)], "pos int, k int, v double, n bigint, cluster int")
    assert clusters.silhouette_1d(values).count() == 0


def test_report_finds_the_groups(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(c, 0.1), 7.0, float(i % 2), None if i % 2 else float(i % 3)) for i, c in
            enumerate([0, 100, 500] * 60)]
    df = spark.createDataFrame(rows, "v double, flat double, two double, gaps double").repartition(4)
    short = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    report = clusters.cluster_report({"t": df, "short": short}).orderBy("column_name", "cluster_id").collect()
    assert {(r["table_name"], r["column_name"]) for r in report} == {("t", "v"), ("t", "gaps")}
    of_v = [r for r in report if r["column_name"] == "v"]
    assert [(r["clusters_chosen"], r["cluster_id"], r["cluster_size"]) for r in of_v] == [
        (3, 0, 60),
        (3, 1, 60),
        (3, 2, 60),
    ]
    assert [round(r["range_low"], -1) for r in of_v] == [0, 100, 500]
    assert sum(r["cluster_size"] for r in report if r["column_name"] == "gaps") == 90


def test_the_layout_does_not_show(spark):
    # a third of the rows share one value
    df = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then 10D when id % 3 = 1 then 1000D + id % 50 else -1000D - id % 50 end as v",
        "round(1000 * sin(id), 3) as w",
    )
    reports = [
        sorted(map(tuple, clusters.cluster_report({"t": df.repartition(n, "w")}).collect())) for n in (1, 3, 8)
    ]
    assert reports[0] == reports[1] == reports[2]
    assert [r[4] for r in reports[0] if r[1] == "v"] == [2000, 2000, 2000]


def test_clusters_without_values_are_not_chosen(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 1, 1, 1, 50, 50, 50, 51, 51]], "v double")
    scores = clusters.cluster_scores({"t": df})
    assert {r["k"] for r in scores.collect()} <= {2, 3, 4}


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert clusters.cluster_report({"t": df}).count() == 0
    assert clusters.cluster_scores({"t": df}).count() == 0


def test_blocks_of_several_values(spark, monkeypatch):
    """The same fits and scores whether the driver knows every value or a few edges."""
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.gauss(i % 4, 0.3), float(i % 50)) for i in range(900)], "v double, w double")
    catalog = {"t": df.repartition(5)}
    whole = sorted(map(tuple, clusters.cluster_report(catalog).collect()))
    scores = {r[:3]: r[3] for r in map(tuple, clusters.cluster_scores(catalog).collect())}
    monkeypatch.setattr(clusters, "BLOCKS", 7)
    assert sorted(map(tuple, clusters.cluster_report(catalog).collect())) == whole
    again = {r[:3]: r[3] for r in map(tuple, clusters.cluster_scores(catalog).collect())}
    assert again == pytest.approx(scores, abs=1e-6) and len(again) > 6


def test_scores_of_fits_by_brute_force(spark):
    rng = random.Random(12)
    values = [round(rng.gauss(10 * (i % 3), 1), 2) for i in range(120)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    targets = clusters._targets({"t": df}, clusters.DEFAULTS)
    index = clusters._index(clusters._histogram({"t": df}, targets))
    fits = clusters._fit(index, clusters.DEFAULTS)
    got = {(r["pos"], r["k"]): r["silhouette"] for r in clusters._silhouettes(index, fits).collect()}
    for (pos, k), centres in fits.items():
        borders = clusters._middles(centres)
        assert got[pos, k] == pytest.approx(silhouette([(v, sum(b < v for b in borders)) for v in values]), abs=1e-9)
