"""Repeated windows against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tablescout.llm.windows import remove_repeats, repeat_report


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def cases():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["état", "naïve", "日本語", "ß"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(70), prose(25)
    long = prose(3000)
    near = long.split(" ")
    for i in range(50, 3000, 170):
        near[i] = "changed"
    rows = [prose(rng.randrange(400)) for _ in range(40)]
    rows += [prose(20) + " " + passage + " " + prose(20) for _ in range(30)]
    rows += [prose(5) + "\n" + line + "\n" + prose(50) for _ in range(20)]
    rows += [long, " ".join(near), long[:2500], long[1000:1200], long[1000:1199], long[3:203]]
    rows += ["a" * 199, "a" * 200, "b" * 201, "b" * 900, "ab" * 300, "日" * 150, "x日" * 150]
    for _ in range(60):
        copy = long.split(" ")[:400]
        for i in rng.sample(range(400), 5):
            copy[i] = rng.choice(words)
        rows.append(" ".join(copy))
    rows += [passage, passage, None, "", "short", "short", prose(100) * 3]
    return rows


@pytest.mark.parametrize(("length", "digit", "bucket"), [(200, 32, 1024), (200, 32, 3), (64, 16, 1024), (255, 40, 8)])
def test_equals_brute_force(spark, documents, length, digit, bucket):
    texts = cases()
    rows = [(i if i % 9 else None, t, "en", "s") for i, t in enumerate(texts)]
    got = remove_repeats(documents(rows).repartition(3), length=length, digit=digit, bucket=bucket).collect()
    wanted = Counter((i if i % 9 else None, *x) for i, x in enumerate(brute(texts, length)))
    found = Counter()
    for r in got:
        edges = [(s["first"], s["last"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(edges, edges[1:], strict=False))
        found[
            r["row"]["doc_id"], r["n_bytes"], sum(b - a for a, b in edges), len(edges), hashlib.sha256(r["kept"]).hexdigest()
        ] += 1
    assert found == wanted


def test_long_text_in_pieces(spark, documents, monkeypatch):
    from tablescout.llm import windows

    monkeypatch.setattr(windows, "PIECE", 1000)
    texts = cases()
    got = repeat_report(documents([(i, t, "en", "s") for i, t in enumerate(texts)]))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert found == dict(enumerate(brute(texts, 200)))


def test_lists_beside_texts_by_shuffle(spark, documents, monkeypatch):
    from tablescout.llm import windows

    monkeypatch.setattr(windows, "SENT_BYTES", 0)
    texts = cases()
    got = repeat_report(documents([(i, t, "en", "s") for i, t in enumerate(texts)]))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert found == dict(enumerate(brute(texts, 200)))


def test_odd_input(spark, documents, odd_texts):
    got = repeat_report(documents(odd_texts))
    texts = [t for _, t, _, _ in odd_texts]
    wanted = Counter((r[0], *x) for r, x in zip(odd_texts, brute([t[:20_000] if t else t for t in texts], 200), strict=True))
    rows = Counter(tuple(r) for r in got.collect())
    assert sum(rows.values()) == len(odd_texts)
    for r, n in wanted.items():
        if r[1] < 20_000:
            assert rows[r] == n
    assert repeat_report(documents([])).count() == 0
    with pytest.raises(ValueError):
        repeat_report(documents([]), text_col="none")
