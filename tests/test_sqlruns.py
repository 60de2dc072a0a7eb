import pytest
from pyspark.sql import functions as F

from tablescout.operators import sqlruns

SCRIPTS = {
    "select 1\nGO\nselect 2": ["select 1", "select 2"],
    "select 1\n  go 5  -- five times\nselect 2\nGo": ["select 1", "select 2"],
    "select 'GO'\nGO;\nselect 2 -- GO": ["select 'GO'\nGO;\nselect 2 -- GO"],
    "GO\n  \ngo\n": [],
    "   ": [],
    "a\nGO\n\n-- note\nb": ["a", "b"],
    "a\nGOTO x\nGO 1 2\nb": ["a\nGOTO x\nGO 1 2\nb"],
    "a\n\n GO\t\nb\nGO--c\nc": ["a", "b", "c"],
    "select 'x\nGO\ny'": ["select 'x", "y'"],
}


def test_batches(spark):
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(SCRIPTS)], "path string, text string")
    got = {}
    for r in sqlruns.sql_batches(df).orderBy("path", "batch_no").collect():
        got.setdefault(r["path"], []).append(r["code"])
        assert r["batch_no"] == len(got[r["path"]])
    for i, expected in enumerate(SCRIPTS.values()):
        assert got.get(f"s{i}", []) == expected


@pytest.mark.parametrize(("given", "limit"), [(3, 3), ("7 ", 7), (0, 10), (-1, 10), ("", 10), ("x", 10)])
def test_row_limit(given, limit):
    assert sqlruns.row_limit(given) == limit


def run(spark, texts, **options):
    scripts = spark.createDataFrame(list(texts.items()), "path string, text string")
    return sqlruns.run_sql_files(spark, scripts, **options)


def test_rows_errors_and_status(spark):
    result = run(
        spark,
        {
            "b/two.sql": "select id, cast(null as int) as x from range(3)\nGO\nselect 1 div 0 as boom\nGO\nselect 3 as n;",
            "one.sql": "select id from range(2)",
            "B/four.sql": "GO",
            "many.sql": "select 1 as a; select 2 as b",
        },
        max_rows=2,
    )
    rows = result.rows.where("path = 'b/two.sql'").orderBy("batch_no", "row_no").collect()
    assert [(r["batch_no"], r["row_no"], r["cells"], r["truncated"]) for r in rows] == [
        (1, 1, ["0", "NULL"], True),
        (1, 2, ["1", "NULL"], True),
        (3, 1, ["3"], False),
    ]
    assert rows[0]["columns"] == ["id", "x"]
    # exactly as many rows as the limit: nothing was cut off
    assert [r["truncated"] for r in result.rows.where("path = 'one.sql'").collect()] == [False, False]
    status = {r["path"]: r["status"] for r in result.files.collect()}
    assert status == {
        "b/two.sql": "COMPLETED WITH ERRORS",
        "one.sql": "SUCCESS",
        "B/four.sql": "EMPTY",
        "many.sql": "SUCCESS",
    }
    many = result.rows.where("path = 'many.sql'").orderBy("result_set_no").collect()
    assert [(r["result_set_no"], r["columns"], r["cells"]) for r in many] == [(1, ["a"], ["1"]), (2, ["b"], ["2"])]
    error = result.files.where("path = 'b/two.sql'").first()["error"]
    assert error.startswith("Batch 2: ") and "DIVIDE_BY_ZERO" in error
    assert tuple(sqlruns.run_summary(result.files).first()) == (4, 2, 1, 1)


def test_files_do_not_share_views(spark):
    texts = {"a.sql": "create temp view only_a as select 1 as x\nGO\nselect * from only_a", "b.sql": "select * from only_a"}
    prepared = []
    result = run(spark, texts, prepare=prepared.append)
    status = {r["path"]: r["status"] for r in result.files.collect()}
    assert status == {"a.sql": "SUCCESS", "b.sql": "COMPLETED WITH ERRORS"}
    assert len(prepared) == 2

    def fails(session):
        raise RuntimeError("no connection")

    result = run(spark, {"a.sql": "select 1"}, prepare=fails)
    assert tuple(result.files.select("status", "error").first()) == ("FAILED", "no connection")
    assert result.batches.count() == 0


def test_folder_breaks(spark):
    paths = ["b/x.sql", "B/a.sql", "b/c.sql", "top.sql", "a/z/q.sql"]
    df = sqlruns.folder_breaks(spark.createDataFrame([(p,) for p in paths], "path string"))
    rows = df.orderBy(F.lower("folder"), F.lower("file_name")).collect()
    assert [(r["path"], r["new_folder"]) for r in rows] == [
        ("top.sql", True),
        ("a/z/q.sql", True),
        ("B/a.sql", True),
        ("b/c.sql", True),
        ("b/x.sql", False),
    ]


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("select 1; select 2;", ["select 1", "select 2"]),
        ("select ';' as a, \";\" as b, `;` from t", ["select ';' as a, \";\" as b, `;` from t"]),
        ("select 'it''s; ok' -- no; end\n; /* a; b */ select 2", ["select 'it''s; ok' -- no; end", "/* a; b */ select 2"]),
        (" ;; -- nothing\n", []),
        ("select 'open; quote", ["select 'open", "quote"]),
    ],
)
def test_statements(code, expected):
    assert sqlruns.statements(code) == expected


def test_a_failing_statement_ends_its_batch(spark):
    result = run(spark, {"a.sql": "select 1 as a; select no_such; select 3 as c\nGO\nselect 4 as d"})
    assert [r["columns"] for r in result.rows.orderBy("batch_no", "result_set_no").collect()] == [["a"], ["d"]]
    assert [r["result_sets"] for r in result.batches.orderBy("batch_no").collect()] == [1, 1]


def test_a_slow_batch_is_stopped_and_the_next_runs(spark):
    slow = "select 1 as a; select sum(id % 7) as b from range(100000000000000); select 2 as c"
    result = run(spark, {"a.sql": f"{slow}\nGO\nselect 4 as d", "b.sql": "select 5 as e"}, batch_seconds=4)
    batches = result.batches.orderBy("path", "batch_no").collect()
    assert [(r["path"], r["result_sets"], r["error"]) for r in batches] == [
        ("a.sql", 1, "stopped after 4 s"),
        ("a.sql", 1, None),
        ("b.sql", 1, None),
    ]
    rows = result.rows.orderBy("path", "batch_no").collect()
    assert [(r["columns"], r["cells"]) for r in rows] == [(["a"], ["1"]), (["d"], ["4"]), (["e"], ["5"])]
    status = {r["path"]: (r["status"], r["error"]) for r in result.files.collect()}
    assert status == {"a.sql": ("COMPLETED WITH ERRORS", "Batch 1: stopped after 4 s"), "b.sql": ("SUCCESS", None)}


def test_rows_keep_the_order_of_the_result(spark):
    code = "select id from range(0, 1000, 1, 8) order by id desc\nGO\nselect id from range(5) where id > 9"
    result = run(spark, {"a.sql": code}, max_rows=3)
    rows = result.rows.orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"], r["truncated"]) for r in rows] == [
        (1, ["999"], True), (2, ["998"], True), (3, ["997"], True)
    ]
    assert [r["result_sets"] for r in result.batches.orderBy("batch_no").collect()] == [1, 1]
