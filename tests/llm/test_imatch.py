import hashlib
import random

from tablescout.llm.imatch import fingerprint_edits


def test_edits(spark, documents, odd_texts):
    r = random.Random(2)
    words = [f"t{i}" for i in range(3000)]
    rows = [(20 + 3 * i, " ".join(r.choices(words, k=r.randint(1, 300))), "en", "a") for i in range(150)]
    rows += [(900, rows[0][1], "en", "a"), *odd_texts]
    got = fingerprint_edits(documents(rows).repartition(5), lowest=0.001, highest=0.5).collect()
    assert len(got) == len(rows)
    ring = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t, _, _ in rows})
    want, prints = {}, {}
    for k, (null, i, _, text) in enumerate(ring):
        after = ring[(k + 1) % len(ring)][3]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        want[(None if null else i, hashlib.sha256(edited.encode()).hexdigest())] = (len(text), text)
    for row in got:
        n, text = want[row["doc_id"], row["edited_sha256"]]
        assert row["n_chars"] == n
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if row["fingerprint"] == row["edited_fingerprint"]:
            assert row["near_edited"] == 1
    assert prints["one two"] == prints["One Two"]
    long = [row for row in got if row["n_chars"] > 400 and row["doc_id"] and row["doc_id"] >= 20]
    assert sum(row["near_edited"] for row in long) / len(long) > 0.4
    assert sum(row["near_next"] for row in long) / len(long) < 0.1


def test_small_tables(spark, documents):
    assert fingerprint_edits(documents([])).count() == 0
    one = fingerprint_edits(documents([(1, "a b c d e f g h", "en", "a")])).first()
    assert one["n_chars"] == 15 and one["near_next"] == 1
    none = fingerprint_edits(documents([(1, None, "en", "a"), (2, "", "en", "a")])).collect()
    assert {(x["fingerprint"], x["near_edited"]) for x in none} == {("none", 1.0)}
