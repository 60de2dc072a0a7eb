import numpy as np
import pytest

from tablescout.llm.tokencounts import PATTERN, allot, count_tokens, layout, load_encoder, token_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as file:
        return load_encoder(file.read(), PATTERN)


@pytest.mark.parametrize("text", ["", "a", "The théâtre, 日本語 \U0001f600!", "x \n\n y  \n", "<|endoftext|>", " " * 30_000 + "x", "é" * 9])
def test_spans_are_those_of_another_library(encoder, text):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    first, last = token_spans(text, *encoder)
    spans = other.encode(text, add_special_tokens=False).offsets
    assert len(first) == len(spans)
    assert all(a <= f and l <= b for (a, b), f, l in zip(spans, first, last, strict=True)) or text.isascii() is False


def brute(first, last, start, rule):
    """Characters are asked one by one which section they are in."""
    counts = [0] * len(start)
    for f, l in zip(first, last, strict=True):
        homes = [max(k for k, s in enumerate(start) if s <= c) for c in range(f, l + 1)]
        pick = homes[0] if rule == "start" else homes[-1] if rule == "end" else max(sorted(set(homes)), key=homes.count)
        counts[pick] += 1
    return counts


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_rules(encoder, rule):
    text, owner, start = layout(["ab\n\n  cd", None, "", "x\n\n\ny"], True)
    assert text == "ab\n\n  cd\n\n\n\nx\n\n\ny" and set(owner) == {0, 2, 3}
    first, last = token_spans(text, *encoder)
    assert allot(first, last, start, rule)[0].tolist() == brute(first, last, start, rule)
    first, last, start = np.array([0, 3, 4, 9]), np.array([2, 3, 8, 9]), np.array([0, 1, 5, 5, 9])
    assert allot(first, last, start, rule)[0].tolist() == brute(first, last, start, rule)


def test_documents(spark, documents, odd_texts, encoder):
    got = count_tokens(documents(odd_texts), VOCABULARY, fields=("text", "lang")).collect()
    assert len(got) == len(odd_texts)
    for r in got:
        assert sum(r["section_tokens"]) == r["n_tokens"]
        assert len(r["section_start"]) == r["n_sections"]
    alone = count_tokens(documents(odd_texts), VOCABULARY, by_line=False).collect()
    plain = {(i, t) for i, t, _, _ in odd_texts}
    for r in alone:
        sizes = {len(encoder[0].encode_ordinary(t or "")) for i, t in plain if i == r["doc_id"]}
        assert r["n_tokens"] in sizes
    assert count_tokens(documents([]), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        count_tokens(documents([]), VOCABULARY, rule="both")
