import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tablescout.llm import kernel, langid, quality, toxicity
from tablescout.llm.common import python_fold
from tablescout.llm.langid import forward, load_pieces, predict_language
from tablescout.llm.quality import SIZE, descend, quality_scores
from tablescout.llm.toxicity import build_index, toxicity_scores

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LABELS = "doc_id bigint, quality int, toxic int, text string, score double"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = {k: [k + "".join(r.choices(c, k=r.randint(2, 6))) for _ in range(300)] for k, c in (("en", "aeth"), ("de", "ßüsch"))}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        text = r.choices(words[lang], k=r.randint(5, 80))
        poor, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            text[r.randrange(len(text))] = r.choice(["badword", "vileness", "vilest"])
        if poor:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), lang, f"s{i % 3}"))
        labels.append((i, int(not poor), int(toxic), "clash", 1.0))
    return rows, labels


def odd_labels(labels):
    return labels + [(1, 1, 0, "", 0.0), (2, None, None, "", 0.0), (None, 0, 1, "", 0.0), (99_999, 0, 1, "", 0.0), (3, 7, 7, "", 0.0)]


@pytest.mark.parametrize(("scorer", "column", "folds", "fold"), [(quality_scores, 1, 4, 2), (toxicity_scores, 2, 3, 1)])
def test_classifiers(spark, documents, odd_texts, corpus, scorer, column, folds, fold):
    rows, labels = corpus
    odd = [(None if i is None else i + 5000, t, lang, s) for i, t, lang, s in odd_texts]
    docs = documents(rows + odd)
    table = spark.createDataFrame(odd_labels(labels), LABELS)
    got = scorer(docs, table).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {label[0]: label[column] for label in labels}
    held = right = 0
    for r in got:
        assert r["held_out"] == (python_fold(r["doc_id"], folds) == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in truth:
            held += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert held > 50 and right / held > 0.95
    # held-out labels do not matter, nor do other columns or the order of rows
    flipped = [(i, 1 - q, 1 - t, x, s) if python_fold(i, folds) == fold else (i, q, t, x, s) for i, q, t, x, s in labels]
    again = scorer(docs.repartition(3).drop("lang", "source"), spark.createDataFrame(odd_labels(flipped), LABELS)).collect()
    first = sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in got)
    assert first == sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in again)


@pytest.mark.parametrize("scorer", [quality_scores, toxicity_scores])
def test_no_labels(spark, documents, odd_texts, scorer):
    none = spark.createDataFrame([], LABELS)
    assert scorer(documents(odd_texts), none).count() == len(odd_texts)
    assert scorer(documents([]), none).count() == 0
    one = spark.createDataFrame([(4, 1, 1, "", 0.0)], LABELS)
    assert scorer(documents(odd_texts), one).count() == len(odd_texts)


def test_descent_reaches_the_optimum():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(40, 8, replace=False)) for _ in range(60)]
    label = np.where([3 in x or 5 in x for x in rows], 1.0, -1.0)
    ratio = np.zeros(SIZE)
    ratio[:40] = r.normal(size=40)
    model = descend(rows, ratio, label, np.ones(60), rounds=2000)
    x = np.zeros((60, 41))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    x[:, 40] = 1

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - label * (x @ w)).sum()

    w = np.append(model.weight[:40] / ratio[:40], model.bias)
    assert all(loss(w) <= loss(w + 0.01 * r.normal(size=41)) + 1e-4 for _ in range(300))


def test_forward_sums_all_segmentations():
    with open(VOCABULARY, "rb") as file:
        pieces = load_pieces(file.read())
    table = np.random.default_rng(1).random((len(pieces.hashes), 2))
    table /= table.sum(axis=0)

    def number(piece):
        h = np.full(1, langid.kernel.START, np.uint64)
        with np.errstate(over="ignore"):
            for b in piece:
                h = langid._step(h, np.uint64([b]))
        return int(pieces.find(h)[0])

    for word in (b"a", b" the", b" hello", b" sch\xc3\xb6ne", b" xqzjkvw"):
        total = np.zeros(2)
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            ids = [number(word[a:b]) for a, b in zip(at, at[1:], strict=False)]
            if min(ids) >= 0:
                total += np.prod(table[ids], axis=0)
        assert np.allclose(forward(np.frombuffer(word, np.uint8)[None], pieces, table), np.log(total))
    long = np.frombuffer(b" " + b"ab" * 2000, np.uint8)[None]
    assert np.isfinite(forward(long, pieces, table)).all()


def test_languages(spark, documents, odd_texts, corpus):
    rows, _ = corpus
    odd = [(None if i is None else i + 5000, t, lang, s) for i, t, lang, s in odd_texts]
    got = predict_language(documents(rows + odd), VOCABULARY).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[k]["lang_pred"] for k in (5001, 5002, 5003, 5008)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert predict_language(documents([]), VOCABULARY).count() == 0
    unknown = predict_language(documents([(1, "hello", None, "a")]), VOCABULARY).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("und", 0.0)


def test_nearest_is_exact():
    r = np.random.default_rng(8)
    vectors = []
    for _ in range(700):
        terms = np.sort(r.choice(50, r.integers(0, 6), replace=False))
        weight = r.random(len(terms)).round(1) + 0.1
        vectors.append((terms, weight / max(1e-9, np.sqrt((weight**2).sum()))))
    ids = r.permutation(700)
    index = build_index(ids, r.integers(0, 2, 700), vectors, 50)
    dense = {int(i): np.zeros(50) for i in ids}
    for i, (t, w) in zip(ids, vectors, strict=True):
        dense[int(i)][t] = w
    for t, w in vectors[:150]:
        query = np.zeros(50)
        query[t] = w
        want = sorted(((-round(float(v @ query), 12), i) for i, v in dense.items() if v @ query > 1e-12))[: toxicity.NEAREST]
        found, cosine = index.nearest(t, w, toxicity.NEAREST)
        assert [i for _, i in want] == index.ids[found].tolist()
        assert np.allclose([-c for c, _ in want], cosine)


def test_toxicity_searches_all_terms(spark):
    """Clean texts have vectors and neighbours too, whatever the mix of labels."""
    r = random.Random(6)
    topics = [[f"{t}{''.join(r.choices('aeiou', k=5))}" for _ in range(30)] for t in "bcdfg"]
    for every in (4, 2):
        rows = [(i, " ".join(r.choices(topics[i % 5], k=25)) + (" vileness" if i % every == 0 else "")) for i in range(240)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, int(i % every == 0)) for i, _ in rows], "doc_id bigint, toxic int")
        for x in toxicity_scores(docs, labels).collect():
            assert len(x["evidence"]) == toxicity.EVIDENCE
            if x["doc_id"] % every:
                assert {e % 5 for e in x["evidence"]} == {x["doc_id"] % 5}


def test_weights_leave_no_term_out():
    counts = np.zeros(2 * toxicity.SIZE)
    counts[:4], counts[toxicity.SIZE : toxicity.SIZE + 4] = (30, 0, 5, 30), (60, 60, 0, 0)
    weight = toxicity.weigh_terms(counts, (30, 60)).weight
    assert (weight > 0).all()
    assert weight[1] > weight[0] and weight[2] > weight[3]


def test_expected_counts_of_long_words():
    """The same counts as over all segmentations, and finite ones over a stretch of any length."""
    with open(VOCABULARY, "rb") as file:
        pieces = load_pieces(file.read())
    table = np.random.default_rng(2).random((len(pieces.hashes), 2))
    table /= table.sum(axis=0)

    def counts(word, t):
        return langid.expected(np.frombuffer(word, np.uint8)[None], np.array([[3.0, 1.0]]), pieces, t)

    # d log Z / d log p is the expected count
    word = np.frombuffer(b" hello schoenes wetter", np.uint8)[None]
    got = counts(b" hello schoenes wetter", table)
    for piece in np.argsort(-got[:, 0])[:5]:
        more = table.copy()
        more[piece] *= 1 + 1e-6
        slope = (forward(word, pieces, more) - forward(word, pieces, table))[0] / 1e-6
        assert np.allclose(got[piece], slope * [3, 1], rtol=1e-3, atol=1e-4)
    long = counts(b" " + b"q" + b"xz" * 127, np.full_like(table, 1e-7))
    assert np.isfinite(long).all() and (long.sum(axis=0) > 0).all()


def test_languages_without_blanks(spark, documents):
    """Words of more than 24 bytes are learned from."""
    r = random.Random(9)
    signs = {"ja": "あいうえおかきくけこさしすせそ", "zh": "天地玄黄宇宙洪荒日月盈昃辰宿列"}
    rows = [(i, "".join(r.choices(signs[k], k=r.randint(20, 150))), k, "a") for i in range(120) for k in [("ja", "zh")[i % 2]]]
    got = predict_language(documents(rows), VOCABULARY).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    held = [x for x in got if x["held_out"]]
    assert held and all(x["lang_pred"] == truth[x["doc_id"]] for x in held)


def test_quality_counts_within_bounds(spark):
    """Features of a batch of 3 MB take little memory; tables are summed by the worker that makes them."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=1000)) for _ in range(500)]
    labels = [i % 2 for i in range(500)]
    batch = pa.record_batch([pa.array(texts), pa.array(labels, pa.int32())], ["text", "label"])
    tracemalloc.start()
    try:
        tables = list(quality._counts(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    chunks = [np.frombuffer(pa.decompress(x.as_buffer(), SIZE // 2, "zstd"), np.uint32) for x in tables[0].column(1)]
    rows = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, label int").repartition(3)
    got = kernel.total_counts(rows, 2 * SIZE, quality.CHUNKS, quality._counts)
    assert got.sum() > 0 and (got == np.concatenate(chunks)).all()
