import math
import re

from tablescout.llm.linededup import drop_boilerplate, url_host
from tablescout.llm.mixing import mix_sources


def test_mix(spark, documents, odd_texts):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "w " * 3, "en", "s0") for i in range(500)] + odd_texts
    got = mix_sources(documents(rows), cells=8).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(documents(rows), cells=64).collect()), key=repr)
    total = sum(r["size"] for r in got)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert r["taken"] <= 3 * r["size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    capped = set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * left / free > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target = 3 * sizes[s] if s in capped else weight[s] * left / free
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target) for r in mine)
        longest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= longest


def test_mix_sizes(spark, documents, odd_texts):
    for r in mix_sources(documents(odd_texts)).collect():
        assert r["size"] in {len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in odd_texts if i == r["doc_id"]}
    assert mix_sources(documents([])).count() == 0


def brute_lines(rows, ratio, least):
    out = []
    for doc, text, _, source in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        pages = [set(x.strip(" \t\n\x0b\x0c\r") for x in (t or "\0").split("\n")) for _, t, _, s in rows if s == source]
        lines = text.split("\n")
        bad = {
            x
            for x in {x.strip(" \t\n\x0b\x0c\r") for x in lines}
            if x and (n := sum(x in p for p in pages)) >= least and n / len(pages) > ratio
        }
        fine = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in bad]
        if not any(x.strip(" \t\n\x0b\x0c\r") for x in fine):
            fine = lines
        out.append((doc, "\n".join(fine), len(lines), len(lines) - len(fine)))
    return sorted(out, key=repr)


def test_lines(spark, documents, odd_texts):
    rows = [(i, f"head\nbody {i}\n\n  foot \nnav {i % 7}", "en", f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, "head\nfoot", "en", "s0") for i in range(4)] + odd_texts
    got = drop_boilerplate(documents(rows), ratio=0.2, min_pages=3)
    assert "n_lines" in got.columns and len(got.columns) == len(set(got.columns))
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(found, key=repr) == brute_lines(rows, 0.2, 3)
    assert drop_boilerplate(documents([])).count() == 0


def test_hosts(spark):
    urls = ["https://User@Blog.Example.org:80/x", "http://a.b", "nothing", None, ""]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_host("u")).collect()
    assert [r[0] for r in got] == ["blog.example.org", "a.b", None, None, None]


def test_lines_of_copies_and_stubs(spark):
    rows = [(i, f"head\nbody {i}\nfoot", "s") for i in range(20)]
    rows += [(100 + i, "head\ncopied text\nmore of it\nfoot", "s") for i in range(10)]
    rows += [(200, "head\nfoot", "s"), (201, "head\n\nfoot", "s"), (202, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = drop_boilerplate(docs, ratio=0.2, distinct_pages=True, whole_pages=False).collect()
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert all(found[i] == (f"body {i}", 3, 2) for i in range(20))
    assert all(found[100 + i] == ("copied text\nmore of it", 4, 2) for i in range(10))
    assert (found[200], found[201], found[202]) == (("", 2, 2), ("", 3, 2), (None, 0, 0))
