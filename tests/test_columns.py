"""Dictionary, keys, outliers, descriptions and correlations on edge cases."""

import random

import numpy as np
import pytest

from tablescout.operators import columns, correlate, describe, dictionary, keys, outliers, preview
from tablescout.options import Options


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def label_of(spark, values):
    df = frame(spark, "v string", [(v,) for v in values])
    row = dictionary.data_dictionary({"t": df}).first()
    return row["data_type"], row["null_count"], row["error_count"], row["blank_count"]


def test_labels(spark):
    assert label_of(spark, ["1"] * 9 + ["x"]) == ("text", 0, 0, 0)
    assert label_of(spark, ["1"] * 10 + ["x"]) == ("numeric (stored as text)", 0, 1, 0)
    assert label_of(spark, ["2020-01-31"] * 9 + ["x"]) == ("text", 0, 0, 0)
    assert label_of(spark, ["2020-01-31"] * 19 + ["2020-02-30"]) == ("date (stored as text)", 0, 1, 0)
    # one layout per column: the other layout counts as an error
    assert label_of(spark, ["2020-01-31"] * 19 + ["2020-01-31 10:00:00"])[2] == 1
    assert label_of(spark, ["31/12/2020", "01/12/2020"]) == ("date (stored as text)", 0, 0, 0)
    assert label_of(spark, [None, None]) == ("unknown (all blank)", 2, 0, 0)
    assert label_of(spark, ["", "  \t", "a", None]) == ("text", 1, 0, 2)
    assert label_of(spark, []) == ("unknown (all blank)", 0, 0, 0)


def test_typed_labels_and_numbering(spark):
    schema = "b boolean, i int, f float, n decimal(9,2), d date, t timestamp, a array<int>, x binary"
    df = frame(spark, schema, [])
    other = frame(spark, "`odd ``name` double", [(float("nan"),), (1.0,)])
    rows = dictionary.data_dictionary({"one": df, "two": other}).orderBy("slno").collect()
    labels = ["boolean", "integer", "decimal", "decimal", "date/time", "date/time", "nested"]
    assert [r["data_type"] for r in rows[:7]] == labels
    assert (rows[8]["slno"], rows[8]["table_no"], rows[8]["column_no"]) == (9, 2, 1)
    assert (rows[8]["column_name"], rows[8]["null_count"], rows[8]["total_rows"]) == ("odd `name", 1, 2)


def test_wide_table_is_split_into_groups(spark):
    df = spark.range(50).selectExpr(*[f"string(id % {i + 1}) as c{i}" for i in range(60)])
    rows = dictionary.data_dictionary({"t": df}).collect()
    assert len(rows) == 60 and {r["data_type"] for r in rows} == {"numeric (stored as text)"}


def test_keys(spark):
    df = frame(spark, "k int, g int, m map<string,int>", [(1, 1, None), (2, None, None), (2, None, None)])
    empty = frame(spark, "k int", [])
    rows = {(r["table_name"], r["column_name"]): r for r in keys.key_candidates({"t": df, "e": empty}).collect()}
    assert rows["t", "k"]["distinct_count"] == 2 and rows["t", "k"]["duplicate_rows"] == 1
    assert rows["t", "g"]["distinct_count"] == 1
    assert rows["e", "k"]["primary_key_candidate"] == "" and rows["e", "k"]["distinct_count"] == 0
    unique = keys.key_candidates({"u": frame(spark, "k int", [(1,), (2,)])}).first()
    assert unique["primary_key_candidate"] == "YES"


def test_distinct_counts_of_every_type(spark):
    schema = "b boolean, f float, n decimal(9,2), d date, x binary"
    rows = [(True, -0.0, None, None, b"a"), (False, 0.0, None, None, b"a"), (None, float("nan"), None, None, b"b")]
    got = keys.cardinality({"t": frame(spark, schema, rows)}).collect()
    assert {r["column_name"]: r["distinct_count"] for r in got} == {"b": 2, "f": 1, "n": 0, "d": 0, "x": 2}


def test_approximate_cardinality(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as g", "string(id % 100) as s")
    got = {r["column_name"]: r["distinct_count"] for r in keys.cardinality({"t": df}, "approximate").collect()}
    assert abs(got["id"] - 5000) < 500 and got["g"] == 7 and abs(got["s"] - 100) <= 5


def test_modes(spark):
    df = frame(
        spark,
        "i int, s string, d double, n string, t date",
        [(10, "a", 1.5, None, None), (9, "b", 1.5, None, None), (2, "a", 2.0, None, None), (100, "b", 1e7, None, None)],
    )
    got = {r["column_name"]: r["mode"] for r in describe.column_mode({"t": df}).collect()}
    assert got == {"i": "2, 9, 10 ...", "s": "a, b", "d": "1.5", "n": "N/A", "t": "N/A"}
    three = frame(spark, "v int", [(3,), (1,), (2,)])
    assert describe.column_mode({"t": three}).first()["mode"] == "1, 2, 3"


def test_outlier_rules(spark):
    three = [(1.0,), (2.0,), (99.0,)]
    flat = [(5.0,)] * 9 + [(6.0,)]
    spread = [(float(v),) for v in (1, 2, 3, 4, 5, 100, -100, 200, -200)]
    catalog = {n: frame(spark, "v double", rows) for n, rows in (("three", three), ("flat", flat), ("spread", spread))}
    report = {r["table_name"]: r for r in outliers.outlier_report(catalog).collect()}
    assert set(report) == {"flat", "spread"}
    assert (report["flat"]["outlier_count"], report["flat"]["outlier_percent"]) == (1, 10.0)
    order = {n: None for n in catalog}
    texts = {r["table_name"]: r["outliers"] for r in outliers.outlier_examples(catalog, order).collect()}
    assert texts["three"] == "N/A" and texts["flat"] == "None"
    values = [v for (v,) in spread]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    beyond = [v for v in values if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    assert texts["spread"] == f"{len(beyond)} found (e.g. {', '.join(str(v) for v in beyond[:3])})"
    assert sorted(r["v"] for r in outliers.outlier_rows(catalog["spread"], "v").collect()) == sorted(beyond)
    assert outliers.outlier_rows(catalog["three"], "v").count() == 0
    with pytest.raises(ValueError):
        outliers.outlier_rows(catalog["three"], "w")


def test_no_numeric_columns(spark):
    df = frame(spark, "s string", [("a",)])
    assert outliers.outlier_report({"t": df}).count() == 0
    assert correlate.correlation_report({"t": df}).count() == 0
    assert outliers.quartiles({"t": df}).count() == 0
    row = describe.describe_tables({"t": df}, {"t": None}).first()
    assert (row["mode"], row["mean"], row["outliers"], row["row_1"], row["row_2"]) == ("a", "N/A", "N/A", "a", "")


def test_failing_columns_are_kept_apart(spark):
    rows = [(i, str(i) if i % 7 else "x", float(i)) for i in range(40)]
    df = frame(spark, "id int, code string, v double", rows)
    view = df.selectExpr(
        "id",
        "if(code = 'x', int(raise_error('no code')), int(code)) as number",
        "v",
        "if(v > 3, raise_error('too much'), 'low') as label",
        "code",
    )
    assert columns.failing_columns(df) == {}
    assert columns.failing_columns(df.limit(0)) == {}
    assert columns.failing_columns(view) == {2: "USER_RAISED_EXCEPTION", 4: "USER_RAISED_EXCEPTION"}
    got = {r["column_name"]: r for r in describe.describe_tables({"t": view, "s": df}, {"t": ["id"], "s": ["id"]})
           .where("table_name = 't'").collect()}
    assert list(got) and len(got) == 5
    for name, kind in (("number", "int"), ("label", "string")):
        r = got[name]
        assert (r["data_type"], r["row_1"], r["mean"], r["median"], r["mode"], r["value_range"], r["outliers"]) == (
            kind, "", "N/A", "N/A", "N/A", "N/A", "N/A (USER_RAISED_EXCEPTION)"
        )
    assert (got["v"]["mean"], got["v"]["row_2"], got["code"]["row_1"]) == ("19.5", "1.0", "x")


def test_describe_leaves_out_empty_tables(spark):
    full, empty = frame(spark, "v int", [(1,)]), frame(spark, "v int", [])
    rows = describe.describe_tables({"e": empty, "f": full}, {"e": None, "f": None}).collect()
    assert [r["table_name"] for r in rows] == ["f"]


def test_correlation_against_numpy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a = 1e9 + rng.random()
        b = a - 1e9 + rng.random() if i % 3 else None
        c = -(a - 1e9) if i % 4 else None
        rows.append((a, b, c, 0.1, float(i % 2) if b is None else 7.0))
    df = frame(spark, "a double, b double, c double, k double, g double", rows)
    got = {(r["column_1"], r["column_2"]): r["correlation"] for r in correlate.correlation_report({"t": df}).collect()}
    names = "abckg"
    assert len(got) == 10
    for (x, y), r in got.items():
        pairs = [
            (row[names.index(x)], row[names.index(y)])
            for row in rows
            if row[names.index(x)] is not None and row[names.index(y)] is not None
        ]
        left, right = zip(*pairs)
        if len(set(left)) == 1 or len(set(right)) == 1:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(left, right)[0, 1], abs=6e-4)
    assert got["a", "c"] == -1.0


@pytest.mark.parametrize("width", [14, 200])
def test_correlation_of_wide_tables(spark, width):
    """Against the narrow path's rules, pair by pair, with gaps, constants and empty columns."""
    rng = np.random.default_rng(width)
    base = rng.normal(size=(300, 1))
    data = 1e6 + base * rng.normal(size=width) + rng.normal(size=(300, width))
    data[:, 3] = 5.0
    data[:, 4] = np.nan
    data[rng.random((300, width)) < 0.1] = np.nan
    data[:150, 5], data[150:, 6] = np.nan, np.nan
    data[:, 7] = 1e6 + np.arange(300)
    names = [f"c{i}" for i in range(width)]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in data]
    df = frame(spark, ", ".join(f"`{n}` double" for n in names), rows).repartition(3)
    got = {(r["column_1"], r["column_2"]): r["correlation"] for r in correlate.correlation_report({"t": df}).collect()}
    assert len(got) == width * (width - 1) // 2
    for i in range(width):
        for j in range(i + 1, width):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            x, y = data[both, i], data[both, j]
            r = got[names[i], names[j]]
            if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
                assert r is None, (i, j)
            else:
                assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=6e-4), (i, j)


def test_wide_tables_are_read_once(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr(*[f"double(id * {i} % 17) as c{i}" for i in range(60)]).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def plan_of(report):
        return report._jdf.queryExecution().optimizedPlan().toString()

    assert plan_of(correlate.correlation_report({"t": df})).count("Relation [") == 1
    whole = {tuple(r) for r in correlate.correlation_report({"t": df}).collect()}
    # blocks of columns beyond the matrix that a task holds
    monkeypatch.setattr(correlate, "BLOCK", 25)
    split = correlate.correlation_report({"t": df})
    assert plan_of(split).count("Relation [") == 3
    rows = [tuple(r) for r in split.collect()]
    assert len(rows) == 60 * 59 // 2 and set(rows) == whole


def test_previews(spark):
    wide = spark.range(20).selectExpr(*[f"id + {i} as c{i:02d}" for i in range(14)])
    empty = frame(spark, "v int", [])
    broken = spark.range(1).selectExpr("raise_error('boom') as v")
    catalog = {"wide": wide, "empty": empty, "broken": broken}
    rows = preview.table_preview(catalog, {"wide": ["c00"], "empty": ["v"], "broken": ["no"]}).collect()
    shown = [r for r in rows if r["table_name"] == "wide"]
    assert len(shown) == 10 and shown[0]["total_rows"] == 20 and len(shown[0]["cells"]) == 12
    assert shown[0]["not_shown"] == "(+2 more column(s) not shown: c12, c13)"
    assert [(r["total_rows"], r["row_no"]) for r in rows if r["table_name"] == "empty"] == [(0, None)]
    assert [r["error"] != "" for r in rows if r["table_name"] == "broken"] == [True]


def test_format_cells(spark):
    df = frame(spark, "a binary, b binary, c double, d boolean", [(b"hi", b"\xff", 2.5e7, None)])
    assert tuple(preview.format_cells(df).first()) == ("hi", "FF", "25000000.0", "NULL")


def test_first_rows_count_is_an_option(spark):
    df = spark.range(9).selectExpr("id")
    row = describe.first_rows({"t": df}, {"t": ["id"]}, Options(first_rows=2)).first()
    assert (row["row_1"], row["row_2"]) == ("0", "1") and not hasattr(row, "row_3")


def test_duplicates_see_maps(spark):
    from tablescout.operators import keys

    df = spark.sql("select 1 as a, map('x', 1, 'y', 2) as m union all select 1, map('y', 2, 'x', 1) union all select 1, map('x', 9)")
    assert keys.table_duplicates(df).first()[0] == 1


def test_catalogs_without_fitting_columns(spark):
    from tablescout.operators import describe, keys

    texts = {"t": spark.createDataFrame([("a",)], "s string")}
    nested = {"t": spark.sql("select array(1) as a")}
    assert describe.numeric_summary(texts).collect() == []
    assert describe.column_mode(nested).collect() == []
    assert keys.cardinality(nested).collect() == []
    assert keys.duplicate_rows(nested).collect() == []
    assert describe.first_rows(nested, {"t": None}).columns[:3] == ["table_name", "column_name", "row_1"]


DATES = {
    "iso": ["2024-01-05", "2024-1-5"],
    "minute": ["2024-01-05 07:30", "2024-1-5 7:30"],
    "second": ["2024-01-05 07:30:15", "2024-12-31 23:59:59"],
    "fraction": ["2024-01-05 07:30:15.123", "2024-01-05 07:30:15.123456"],
    "zone": ["2024-01-05T07:30:15Z", "2024-01-05T07:30:15.250+02:00"],
    "us": ["1/5/2024", "12/31/2024"],
    "eu": ["31/1/2024", "1/12/2024"],
    "us_time": ["1/5/2024 7:30", "12/31/2024 23:59"],
    "short_year": ["1/5/24", "12/31/99"],
    "dots": ["5.1.2024", "31.12.2024"],
    "month": ["5 Jan 2024", "31 Dec 2024"],
    "full_month": ["5 January 2024", "31 December 2024"],
    "named": ["January 5, 2024", "September 30, 2024"],
}
NO_DATES = {"day_32": ["32/13/2024", "1/5/2024"], "words": ["Maybe 5, 2024", "5 Foo 2024"], "version": ["1.2.3.4", "10.0.0.1"]}


def test_date_layouts(spark):
    from tablescout.operators.dictionary import data_dictionary

    columns = DATES | NO_DATES
    rows = [tuple(v[i] for v in columns.values()) for i in range(2)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    found = {r["column_name"]: (r["data_type"], r["error_count"]) for r in data_dictionary({"t": df}).collect()}
    for name in DATES:
        assert found[name] == ("date (stored as text)", 0), (name, found[name])
    assert all(found[name][0] != "date (stored as text)" or found[name][1] for name in NO_DATES)


def test_describe_without_rows(spark):
    from tablescout.operators import describe

    empty = spark.createDataFrame([], "a int, b string")
    got = describe.describe_tables({"e": empty}, {"e": None})
    full = describe.describe_tables({"e": spark.createDataFrame([(1, "x")], "a int, b string")}, {"e": None})
    assert got.collect() == [] and got.columns == full.columns
