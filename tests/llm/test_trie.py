"""The trie against brute force over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablescout.llm.trie import conversation_trie, spliced_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, place string, k string, n string, depth string"


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, x in convs.items()}


def splice(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], SCHEMA)


def cases():
    rng = random.Random(6)
    rows = []
    for c in range(-7, 120):
        shared = c % 7
        n = rng.randrange(1, 14)
        for t in range(n):
            text = f"said {shared} {t}" if t < n - c % 3 else f"own {rng.randrange(4)} é"
            rows.append((c, t, rng.choice(["user", "user", None]) if t > 4 else "user", text))
    rows += [(200, t, "user", f"long {t}") for t in range(60)] + [(201, t, "user", f"long {t}") for t in range(57)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    rows += [(400, None, None, None), (400, 1, "a", None), (400, 1, "a", "b"), (400, 1, "", "ab"), (401, 5, "ab", "")]
    rows += [(None, 1, "user", "x"), (4_000_000_000_000, 0, "user", "same"), (400, 1, "a", "b")]
    return rows


@pytest.mark.parametrize("block", [1, 4, 7])
def test_equals_brute_force(spark, block):
    rows = cases()
    got = conversation_trie(conversations(spark, rows), block=block)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert sorted(map(tuple, got.collect())) == brute(ordered(rows))


def test_spliced(spark):
    rows = cases()
    rows += [(c, t, "user", f"said {c} {t}") for c in range(505, 510) for t in range(1 + c % 2)]
    rows += [(c, 0, "user", "alone") for c in range(601, 640) if c % 5]  # their c - c % 5 is absent
    got = spliced_trie(conversations(spark, [r for r in rows if r[0] is None or r[0] >= 0]))
    wanted = splice(ordered([r for r in rows if r[0] is None or r[0] >= 0]))
    assert any(not turns for turns in wanted.values())
    assert sorted(map(tuple, got.collect())) == brute(wanted)


def test_long_conversations_in_stretches(spark, monkeypatch):
    from tablescout.llm import trie

    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "ENDS_BITS", 2)
    rows = cases()
    got = conversation_trie(conversations(spark, rows), block=2)
    assert sorted(map(tuple, got.collect())) == brute(ordered(rows))


def test_empty(spark):
    assert conversation_trie(conversations(spark, [])).count() == 0
    got = conversation_trie(conversations(spark, [(3, None, None, None), (3, None, None, None)])).collect()
    assert [tuple(r)[:7] for r in sorted(got)] == [(3, 0, None, 1, 1, 1, 0), (3, 1, 3, 1, 1, 1, 0), (3, 2, 3, 1, 0, 1, 0)]
    with pytest.raises(ValueError):
        conversation_trie(conversations(spark, []).drop("text"))
