"""Runs against brute force over all periods, and a grammar that gives its text back."""

import random
import zlib

import numpy as np
import pytest

from tablescout.llm.kernel import mix
from tablescout.llm.runs import collapse_runs, find_runs, repair, run_report


def brute(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences():
    rng = random.Random(8)
    out = [[], [1], [1] * 23, [1] * 24, [1] * 25, [1, 2] * 12, [1, 2] * 11 + [1], list(range(100)), [1] * 3000]
    for _ in range(150):
        base = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randrange(200))]
        p = rng.randrange(1, 60)
        block = [rng.randrange(40) for _ in range(p)]
        copy = (block * 12)[: rng.randrange(2 * p, 8 * p)]
        out.append(base + copy + base[: rng.randrange(50)] + (copy if rng.random() < 0.4 else []))
    for _ in range(20):  # runs in runs
        inner = [rng.randrange(3)] * rng.randrange(20, 40)
        out.append(([7, 8, 9] + inner) * rng.randrange(2, 6) + [rng.randrange(9)] * rng.randrange(40))
    out += [thue_morse(5000), fibonacci(2000), [i % 7 for i in range(700)] + [i % 5 for i in range(500)]]
    out += [[rng.randrange(2) for _ in range(3000)], [0] * 1000 + [1] + [0] * 1000]
    return out


def together(many):
    flat = np.array([v for s in many for v in s], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(s) for s in many])]).astype(np.int64)
    return mix(flat + np.uint64(11)), first


@pytest.mark.parametrize(("least", "times"), [(24, 3), (30, 4)])
def test_equals_brute_force(least, times):
    many = sequences()
    of, start, end, period = find_runs(*together(many), least, times)
    got = {}
    for t, s, e, q in zip(of.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        got.setdefault(t, []).append((s, e - s, q))
    for t, words in enumerate(many):
        assert got.get(t, []) == brute(words, least, times), t


def test_chunks_of_candidates(monkeypatch):
    from tablescout.llm import runs

    whole = find_runs(*together(sequences()))
    monkeypatch.setattr(runs, "TOGETHER", 50)
    assert all((a == b).all() for a, b in zip(whole, find_runs(*together(sequences())), strict=True))


def test_no_pair_is_left_twice():
    many = [s for s in sequences() if len(s) >= 24]
    hashes, first = together(many)
    text = np.repeat(np.arange(len(many)), np.diff(first))
    own = np.unique(mix(hashes + text.astype(np.uint64) * np.uint64(77)), return_inverse=True)[1]
    grammar = repair(own, text, first[1:], 24)
    # a run of n equal words leaves about log n symbols
    assert (grammar.text == next(i for i, s in enumerate(many) if len(s) == 3000)).sum() < 20
    assert set(first[:-1]) <= set(grammar.starts.tolist())
    for (low, middle, high), (of, place) in zip(grammar.nodes, grammar.places, strict=True):
        assert (low < middle).all() and (middle < high).all()
        for k, at in zip(of.tolist(), place.tolist(), strict=True):  # all places derive the same words
            assert (own[at : at + high[k] - low[k]] == own[low[k] : high[k]]).all()


def contract(doc, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
    words = [w for w in words.split(" ") if w]
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return words, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_report(spark, documents, odd_texts):
    import hashlib
    from collections import Counter
    from fractions import Fraction

    rng = random.Random(2)
    rows = [r for r in odd_texts if not r[1] or len(r[1]) < 60_000]
    rows += [(i, " ".join(rng.choice(["a", "ä b", "c d"]) for _ in range(rng.randrange(90))), "en", "s") for i in range(200)]
    rows += [(500, "x y  z\n" * 30, "en", "s"), (500, "x y  z\n" * 30, "en", "s"), (501, None, "en", "s")]
    wanted = Counter()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc, text, _, _ in rows:
        _, runs, left = contract(doc, text)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        wanted[(doc, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(left))] += 1
    assert Counter(map(tuple, run_report(documents(rows)).collect())) == wanted
    assert run_report(documents([])).count() == 0


def test_general(spark, documents, odd_texts):
    got = collapse_runs(documents([*odd_texts, (20, "so it is " * 20 + "said", "en", "s")]))
    assert got.count() == len(odd_texts) + 1
    row = got.filter("row.doc_id = 20").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60, 3)]
    assert (row["n_words"], row["collapsed"]) == (61, "so it is said")
    assert got.filter("row.doc_id = 6").first()["n_words"] == 60_000
    with pytest.raises(ValueError):
        collapse_runs(documents([]), least=10)
