import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa

from tablescout.llm import decontaminate
from tablescout.llm.decontaminate import B, K1, SEGMENT, STEP, find_leaks

ITEM = "item_id bigint, text string, answer string, doc_id bigint, score double, item string"


def words(text):
    return re.findall(r"[a-z0-9\x80-￿]+", (text or "").lower())


def brute(docs, items, share, overlap):
    """(doc, item) by scoring every segment against every window."""
    parts = [(n, words(q)[a : a + SEGMENT]) for n, (_, q, _) in enumerate(items) for a in range(0, len(words(q)), SEGMENT)]
    df = Counter(t for _, p in parts for t in set(p))
    mean = sum(len(p) for _, p in parts) / max(1, len(parts))

    def score(part, there):
        total = 0
        for t, c in Counter(part).items():
            if t in there:
                idf = math.log1p((len(parts) - df[t] + 0.5) / (df[t] + 0.5))
                total += idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(part) / mean))
        return total

    def found(wanted, mine):
        k = min(5, len(wanted))
        grams = {tuple(wanted[i : i + k]) for i in range(len(wanted) - k + 1)} if k else set()
        there = {tuple(mine[i : i + k]) for i in range(len(mine) - k + 1)} if k else set()
        return len(grams & there) / len(grams) if grams else 1

    out = Counter()
    for doc, text in docs:
        mine = words(text)
        hits = set()
        for a in range(0, max(1, len(mine) - STEP), STEP):
            there = set(mine[a : a + 2 * STEP])
            hits |= {n for n, p in parts if score(p, there) >= share * score(p, set(p)) * (1 - 1e-12)}
        for n in hits:
            item, question, answer = items[n]
            if min(found(words(question), mine), found(words(answer), mine)) >= overlap:
                out[doc, item] += 1
    return out


def test_brute_force(spark, documents, odd_texts):
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]

    def text(n):
        return [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)]

    items = [(n, " ".join(text(r.randint(1, 60))), None) for n in range(60)]
    items += [(60, " ".join(text(150)), None), (61, None, None), (62, " ?! ", None), (None, "null id item " * 3, None)]
    items += [(63, items[0][1], "the answer"), (63, items[0][1], "the answer")]
    docs = []
    for i in range(120):
        t = text(r.choice([3, 40, 200, 900]))
        for _ in range(r.randint(0, 2)):
            piece = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 4, 12])):
                if piece:
                    piece[r.randrange(len(piece))] = r.choice(rare)
            at = r.randint(0, len(t))
            t[at:at] = piece if r.random() < 0.7 else [x.upper() + "," for x in piece]
        docs.append((i, " ".join(t), "en", "a"))
    docs += odd_texts + [(700, items[0][1] + " The ANSWER.", "en", "a"), (None, items[5][1], "en", "a")]
    table = spark.createDataFrame([(*i, 1, 1.0, "x") for i in items], ITEM)
    want = brute([d[:2] for d in docs], items, 0.4, 0.5)
    assert len(want) > 20
    for most in (2_000_000, 700):  # one index, several indexes
        got = find_leaks(documents(docs), table, answer_col="answer", index_words=most).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in got) == want


def test_empty(spark, documents):
    table = spark.createDataFrame([(1, "a b c", None, 1, 1.0, "x")], ITEM)
    assert find_leaks(documents([]), table).count() == 0
    assert find_leaks(documents([(1, "a b c", "en", "a")]), table.limit(0)).count() == 0
    got = find_leaks(documents([(1, "x A, b c! y", "en", "a")]), table).first()
    assert (got["doc_id"], got["item_id"], got["overlap"]) == (1, 1, 1.0)


def test_search_opens_windows_by_their_work(monkeypatch):
    """A slice whose windows meet many items takes little memory, and any chunk finds the same."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = pa.record_batch(
        [pa.array(range(300)), pa.array([" ".join(r.choices(vocabulary, k=40)) for _ in range(300)]), pa.array([""] * 300)],
        ["item", "question", "answer"],
    )
    rows = [x for batch in decontaminate._read_items(iter([items])) for x in batch.to_pylist()]
    df = Counter(t for x in rows for s in x["segments"] for t in s["terms"])
    index = decontaminate.build_index(rows, df, 300, 40.0, 0.4)
    texts = pa.array([" ".join(r.choices([*vocabulary, *(f"x{i}" for i in range(50))], k=1000)) for _ in range(200)])
    [(_, _, w, hashes)] = decontaminate._hashed(texts)
    tracemalloc.start()
    try:
        found = decontaminate.search(index, w, hashes)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert found
    monkeypatch.setattr(decontaminate, "CELLS", 1)  # a window at a time
    assert decontaminate.search(index, w, hashes) == found
