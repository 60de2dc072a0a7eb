"""Token counts per field and section from one encoding of the whole document.

The fields of a document are joined by a blank line and encoded once with a byte-level BPE
vocabulary. The bytes of a text are the concatenation of its tokens' bytes, so the running
sum of token lengths gives every token's span, exactly. Spans are mapped to characters and
joined with the sections' intervals (both are sorted, so a binary search per token does
it). A token that crosses a boundary goes to one section by `rule`:

- "start": the section of its first character,
- "end": the section of its last character,
- "most": the section with most of its characters, the earlier one of equals.

A token that holds part of a character counts as touching that character. The separator
between two fields belongs to the field before it.

Scale: one pass, no shuffle; the vocabulary (under 2 MB) is read by the driver and broadcast.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, small_batches

RULES = ("start", "end", "most")
BETWEEN = "\n\n"
COUNTED = (
    "id long, n_chars long, n_tokens long, n_crossing long, n_sections int, "
    "section_field array<int>, section_start array<long>, section_tokens array<long>"
)
ROWS_OUT = 2_000
# White space longer than this is encoded in parts: the splitting pattern always ends a
# piece before the last white-space character of a run, so the tokens stay the same.
LONG_GAP = 10_000
GAP = re.compile(r"[ \t-\r]{%d,}" % LONG_GAP)
# fixed value: how the vocabulary's tokenizer splits a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load_encoder(vocabulary: bytes, pattern: str):
    """The encoder and every token's length in bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def layout(fields: Sequence[str | None], by_line: bool) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined document, and of every section its field and its first character."""
    text, owner, start = "", [], []
    present = [(n, f) for n, f in enumerate(fields) if f is not None]
    for k, (n, field) in enumerate(present):
        piece = field + (BETWEEN if k + 1 < len(present) else "")
        owner.append(n)
        start.append(len(text))
        if by_line:
            at = field.find("\n")
            while at >= 0:
                owner.append(n)
                start.append(len(text) + at + 1)
                at = field.find("\n", at + 1)
        text += piece
    return text, np.array(owner, np.int64), np.array(start, np.int64)


def token_spans(text: str, encoder, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of every token of a text."""
    gaps = (m.end() for m in GAP.finditer(text))
    cuts = [0, *(e - 1 for e in gaps if e < len(text) and not text[e].isspace()), len(text)]
    parts = [encoder.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in zip(cuts, cuts[1:], strict=False)]
    tokens = np.concatenate(parts).astype(np.int64)
    ends = np.cumsum(lengths[tokens])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(ends) and ends[-1] != len(data):
        raise ValueError("the tokens do not cover the text")
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[ends - lengths[tokens]], character[ends - 1]


def allot(first: np.ndarray, last: np.ndarray, start: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens cross a boundary."""
    low = np.searchsorted(start, first, side="right") - 1
    high = np.searchsorted(start, last, side="right") - 1
    crossing = np.flatnonzero(low != high)
    home = (high if rule == "end" else low).copy()
    if rule == "most":
        for t in crossing:
            edges = np.concatenate([[first[t]], start[low[t] + 1 : high[t] + 1], [last[t] + 1]])
            home[t] = low[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(home, minlength=len(start)), len(crossing)


def _count(shared, pattern: str, by_line: bool, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = load_encoder(shared.value, pattern)
        names = [x.strip().split(" ")[0] for x in COUNTED.split(",")]
        small, large = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [pa.int64()] * 4 + [pa.int32(), small, large, large]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                rows = []
                part = batch.slice(at, ROWS_OUT)
                for values in zip(*part.columns, strict=True):
                    fields = [v.as_py() for v in values[1:]]
                    text, owner, start = layout(fields, by_line)
                    first, last = token_spans(text, encoder, lengths)
                    counts, crossing = allot(first, last, start, rule) if len(start) else (owner, 0)
                    rows.append((values[0].as_py(), len(text), len(first), crossing, len(start), owner, start, counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
                )

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("text",),
    by_line: bool = True,
    rule: str = "start",
    pattern: str = PATTERN,
) -> DataFrame:
    """One row per input row: id, n_chars, n_tokens, n_crossing, n_sections and three arrays
    with a section's field number, first character and tokens.

    A section is a line with its line feed (`by_line`) or a whole field. A null field has no
    section and does not join; an empty one has a single section without tokens. A document
    without fields has no tokens. Ids may be null or repeat, rows are counted one by one.
    Other columns are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    check_columns(docs, [id_col, *fields])
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        *[F.col(f"`{f}`").cast("string").alias(f"field{n}") for n, f in enumerate(fields)],
    )
    counted = rows.mapInArrow(_count(shared, pattern, by_line, rule), COUNTED)
    return counted.withColumnRenamed("id", id_col)
