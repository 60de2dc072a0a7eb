import importlib
import subprocess
import sys
import time
from pathlib import Path

import __spark_entry__
import corpus_pipeline
from tablescout.llm import kernel
from tablescout.llm.common import table
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngramjoin import brute as near

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"], None) for r in table(spark, small, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.kept(stage(spark, docs, small), "test-stage")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "line dedup":
            assert ids == set(before)
            assert out.filter("n_chars <> char_length(text)").count() == 0
        if name == "n-gram Jaccard join":
            want = {d for (d, _, c, _) in near(list(before.items()), 5, 80) if d == c}
            assert ids == want
        if name == "benchmark decontamination":
            assert set(before) - ids == {d for d, _ in leaks(list(before.items()), items, 0.4, 0.5)}
        docs = out
    assert docs.count() > 0


def test_run_is_the_stages(spark, small):
    one = sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))
    assert one == sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))


def test_every_query_is_there():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry_without_the_package(tmp_path):
    """The entry module imports where the package and the pipeline are absent."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('tablescout.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
    importlib.invalidate_caches()


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Repeated rows, rows without an id and rows that share an id with others."""
    copy = " ".join(f"c{i}" for i in range(60))
    item = " ".join(f"leak{i}" for i in range(60))
    own = [" ".join(f"{w}{i}" for i in range(60)) for w in "abdefg"]
    rows = [(1, copy)] * 3 + [(2, copy), (2, own[0]), (None, copy), (None, own[1]), (None, own[1]), (3, own[2]), (3, own[2] + " x")]
    rows += [(4, item), (4, own[3]), (None, item + " tail"), (5, None), (None, own[4])]
    docs = spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, row_number int")
    spark.createDataFrame([(None, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for parts in (1, 4):
        near = corpus_pipeline.kept(corpus_pipeline.near_duplicates(spark, docs.repartition(parts), str(tmp_path)), "test-near")
        assert near.columns == docs.columns
        left = [(r["doc_id"], (r["text"] or "")[:3]) for r in near.collect()]
        want = [(1, "c0 "), (2, "a0 "), (None, "b0 "), (3, "d0 "), (4, "lea"), (4, "e0 "), (5, ""), (None, "f0 ")]
        assert sorted(left, key=repr) == sorted(want, key=repr)
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(r["row_number"] for r in clean.collect()) == [*range(10), 11, 13, 14]


def test_content_of_copies_is_no_boilerplate(spark, tmp_path):
    rows = [(i, f"head\nbody {i}", "en", "s", 0) for i in range(20)] + [(50 + i, "head\ncopied\ntext", "en", "s", 0) for i in range(10)]
    rows += [(90, "copied\nonly here", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left[0] == "body 0" and left[50] == "copied\ntext" and left[90] == "copied\nonly here"


def test_columns_of_any_name_pass_through(spark, small):
    """Stages keep columns that bear the names of their own results."""
    own = ["score", "predicted", "held_out", "n_lines", "n_dropped", "row", "_", "k0", "id", "label"]
    docs = table(spark, small, "documents").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in own])
    for name, stage in corpus_pipeline.STAGES[:2]:
        plain = stage(spark, docs.drop(*own), small)
        docs = corpus_pipeline.kept(stage(spark, docs, small), "test-names")
        assert docs.columns == [*plain.columns, *own], name
        rows = docs.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in own)
        assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[: -len(own)] for r in rows)


def test_workers_give_free_memory_back(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(kernel, "give_back", lambda: given.append(1))
    batches = [pa.record_batch([pa.array([i])], ["x"]) for i in range(3)]
    run = kernel.tidy(lambda some: (b for b in some))
    assert list(run(iter(batches))) == batches and given == [1]
    stopped = run(iter(batches))
    next(stopped)
    stopped.close()
    assert given == [1, 1]


def test_near_duplicates_leave_no_shuffle_files(spark, small):
    """Shuffles of the join go with the query that made them, and the setting is as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {str(f) for f in store.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}

    docs = corpus_pipeline.kept(table(spark, small, "documents"), "test-shuffles")
    there = shuffles()
    corpus_pipeline.near_duplicates(spark, docs, small)
    until = time.time() + 10  # files go in the background
    while shuffles() - there and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - there
    assert spark.conf.get(name) == before
