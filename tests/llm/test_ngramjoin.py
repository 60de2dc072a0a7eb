import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablescout.llm import kernel, ngramjoin
from tablescout.llm.common import kept
from tablescout.llm.components import components
from tablescout.llm.ngramjoin import links_between, ngram_jaccard_join


def brute(rows, size, percent):
    """(id, n_shingles, component, links) by row position, comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        whole = [tuple(w)] if w else []
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else set(whole))
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and rows[i][0] is not None and rows[j][0] is not None:
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return Counter(
        (d, len(s), *((min(least[root(i)]), links[i]) if d is not None else (None, None)))
        for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))
    )


def near_copies(seed):
    """Groups of copies with more and more edits, some of them chained."""
    r = random.Random(seed)
    rows, words = [], [f"v{i}" for i in range(400)]
    for _ in range(12):
        text = [r.choice(words) for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(1, 12)):
            rows.append((len(rows), " ".join(text)))
            if r.random() < 0.7:
                text = list(text)
                text[r.randrange(len(text))] = r.choice(words)
    passage = " ".join(r.choice(words) for _ in range(40))
    for _ in range(40):
        rows.append((len(rows), passage + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 60)))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "group"), [(3, 90, 32_768), (5, 80, 300)])
def test_brute_force(spark, documents, size, percent, group):
    rows = near_copies(size)
    docs = documents([(i, t, "en", "a") for i, t in rows])
    got = ngram_jaccard_join(docs, size=size, percent=percent, group_tokens=group)
    assert Counter(map(tuple, got.collect())) == brute(rows, size, percent)


def test_odd_texts(spark, documents, odd_texts):
    got = ngram_jaccard_join(documents(odd_texts), size=3, percent=90)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert Counter(map(tuple, got.collect())) == brute([(i, t) for i, t, _, _ in odd_texts], 3, 90)
    assert ngram_jaccard_join(documents([]), size=3).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark, documents):
    r = random.Random(4)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(60)] for x in "ab")
    rows = [(5, a), (5, b), (3, [*a, "new"]), (9, [*b, "more"]), (None, a), (5, a), (7, a)]
    # near copies of one group under one id
    rows += [(20 + i // 4, [*a, *(f"z{i}_{k}" for k in range(i % 3))]) for i in range(12)]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = ngram_jaccard_join(documents([(i, t, "en", "a") for i, t in rows]), size=3, percent=90)
    found = Counter(map(tuple, got.collect()))
    assert found == brute(rows, 3, 90)
    assert {(i, c) for i, _, c, _ in found if i in (3, 9)} == {(3, 3), (9, 5)}


def test_near_copies_meet_in_few_groups(spark, documents, monkeypatch):
    r = random.Random(8)
    text = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(600):
        edited = list(text)
        for _ in range(r.randrange(3)):
            edited[r.randrange(60)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    pairs = []

    def seen(df, label):
        df = kept(df, label)
        if label == "ngram-pairs":
            pairs.append(df.count())
        return df

    monkeypatch.setattr(ngramjoin, "kept", seen)
    got = ngram_jaccard_join(documents([(i, t, "en", "a") for i, t in rows]), size=3, percent=90)
    assert Counter(map(tuple, got.collect())) == brute(rows, 3, 90)
    # 600 sets of 188 tokens with their weight are four groups' worth
    assert pairs[0] < 100


def test_links_are_complete():
    r = np.random.default_rng(3)
    one = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    two = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(9)]
    for first, second in ((one, two), (one, None)):
        everything = first + (second or [])
        linked = {
            (i, j)
            for i in range(len(first))
            for j in range(len(first) if second else i + 1, len(everything))
            if 100 * len(np.intersect1d(everything[i], everything[j])) >= 40 * len(np.union1d(everything[i], everything[j]))
        }
        found = [(i, int(j)) for i, js in links_between(first, second, 40) for j in js]
        assert linked and len(found) == len(set(found)) and set(found) == linked


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 202), (5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()))
    assert got == {**{i: 1 for i in [*range(1, 41), 100]}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_words_never_span_texts():
    import pyarrow as pa

    texts = ["ab", "c d", "", None, " e", "f ", "A\x0bB\x1cC"]
    data, offsets = kernel.flat(pa.array(texts))
    w = kernel.words_of(data, offsets)
    words = [w.word(i) for i in range(len(w.start))]
    assert words == [b"ab", b"c", b"d", b"e", b"f", b"a", b"b\x1cc"]
    assert w.counts.tolist() == [1, 2, 0, 0, 1, 1, 2]
