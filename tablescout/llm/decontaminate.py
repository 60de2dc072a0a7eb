"""Find benchmark items in training documents: BM25 over the items, then n-gram overlap.

The items are the index, every passage of every document is a query. Items are cut into
segments of `SEGMENT` words; documents are read as windows of two steps of `STEP` words, so
every run of STEP words lies whole in one window. A segment's BM25 score for a window is
divided by its threshold, `share` of the score it has for its own text; what reaches 1 is
retrieved, all of it.

Search is block-max WAND for a batch of windows at once:
- a window whose terms' largest scores do not add up to 1 is skipped;
- postings are in blocks of BLOCK segments with the largest score of each term in the block;
  the most widespread terms, which together stay under a part of the threshold, are not
  followed into the blocks but counted with their largest score (the non-essential lists);
- only blocks whose bound reaches 1 are scored in full.

A retrieved item is then held against the whole document: the share of its n-grams that
occur there must reach `overlap`, and the same for its answer where there is one.

Scale: one pass over the documents per index, no shuffle of documents. An index holds
items of about `index_words` words, the stated bound of what is broadcast; more items are
searched index by index, with document frequencies and lengths of all items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm import kernel
from tablescout.llm.common import arrived, check_columns, kept, ship, small_batches, text_of

SEGMENT = 48
STEP = 64
BLOCK = 16
K1, B = 1.2, 0.75
GRAM = 5
FREE = 0.3  # what the non-essential terms may add up to, of a threshold of 1
SAFE = 1 - 1e-9
FRONT = 20  # bits of a hash that are looked up before the hash
CELLS = 1 << 18  # terms, postings and block sums at once; the windows after the first wait

ITEM = (
    "item long, words long, segments array<struct<terms array<long>, counts array<long>>>, "
    "size int, grams array<long>, answer_size int, answer_grams array<long>"
)
FOUND = "doc long, item long, score double, overlap double, answer_overlap double"


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, kernel.Words, np.ndarray]]:
    """Words of lower-cased texts without ASCII punctuation, with their hashes, by slices."""
    for low, high, data, offsets in kernel.texts(column, lower=True):
        w = kernel.words_of(data, offsets, gaps=kernel.MARK)
        yield low, high, w, kernel.hash_words(w)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct n-grams of one text; shorter texts are one n-gram."""
    w = kernel.Words(None, None, None, np.array([0, len(hashes)]), None)
    return np.unique(kernel.shingles(w, hashes, size)[0])


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as segments of term counts and as n-grams."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        both = []
        for column in (batch.column(1), batch.column(2)):
            both.append([h[w.first[i] : w.first[i + 1]] for _, _, w, h in _hashed(column) for i in range(len(w.first) - 1)])
        rows = []
        for item, question, answer in zip(ids, *both, strict=True):
            segments = []
            for at in range(0, len(question), SEGMENT):
                terms, counts = np.unique(question[at : at + SEGMENT], return_counts=True)
                segments.append({"terms": terms.view(np.int64).tolist(), "counts": counts.tolist()})
            rows.append({
                "item": item, "words": len(question), "segments": segments,
                "size": min(GRAM, len(question)), "grams": _grams(question, GRAM).view(np.int64).tolist(),
                "answer_size": min(GRAM, len(answer)), "answer_grams": _grams(answer, GRAM).view(np.int64).tolist(),
            })
        part = pa.struct([("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        kinds = [pa.int64(), pa.int64(), pa.list_(part), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        names = "item words segments size grams answer_size answer_grams".split()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names
        )


@dataclass
class Index:
    """Normalised BM25 postings in blocks. Arrays `x_at` say where a term's part of x starts."""

    terms: np.ndarray
    top: np.ndarray
    essential: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    post_at: np.ndarray
    segment: np.ndarray
    score: np.ndarray
    item_of: np.ndarray
    items: list[tuple[int, int, np.ndarray, int, np.ndarray]]

    @property
    def blocks(self) -> int:
        return -(-len(self.item_of) // BLOCK)

    @cached_property
    def seen(self) -> np.ndarray:
        """Whether some term begins with these FRONT bits."""
        out = np.zeros(1 << FRONT, bool)
        out[self.terms >> np.uint64(64 - FRONT)] = True
        return out

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of hashes that are terms, and which terms they are."""
        likely = np.flatnonzero(self.seen[hashes >> np.uint64(64 - FRONT)])
        mine = hashes[likely]
        at = np.searchsorted(self.terms, mine)
        at[at == len(self.terms)] = 0
        found = self.terms[at] == mine
        return likely[found], at[found]


def _distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values of whole numbers."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=-1))]


def build_index(items: list, df: dict[int, int], segments: int, words: float, share: float) -> Index:
    """items are rows of ITEM; df, segments and mean words per segment are those of all items."""
    rows, item_of, verify = [], [], []
    for n, r in enumerate(items):
        as_set = (r["size"], np.array(r["grams"], np.int64).view(np.uint64))
        answer = (r["answer_size"], np.array(r["answer_grams"], np.int64).view(np.uint64))
        verify.append((r["item"], *as_set, *answer))
        for part in r["segments"]:
            counts = np.array(part["counts"], float)
            found = np.array([df[t] for t in part["terms"]], float)
            idf = np.log1p((segments - found + 0.5) / (found + 0.5))
            score = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * counts.sum() / words))
            rows.append((np.array(part["terms"], np.int64).view(np.uint64), score / (share * score.sum())))
            item_of.append(n)
    if not rows:
        none = np.zeros(0, np.int64)
        zero = np.zeros(1, np.int64)
        return Index(none.view(np.uint64), none, none, zero, none, none, zero, none, none, none, [])
    term = np.concatenate([t for t, _ in rows])
    score = np.concatenate([s for _, s in rows])
    segment = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    terms, number = np.unique(term, return_inverse=True)
    order = np.lexsort((segment, number))
    number, segment, score = number[order], segment[order], score[order]
    post_at = np.searchsorted(number, np.arange(len(terms) + 1))
    key = number * (len(rows) // BLOCK + 1) + segment // BLOCK
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    block_at = np.searchsorted(number[heads], np.arange(len(terms) + 1))
    top = np.maximum.reduceat(score, post_at[:-1])
    spread = np.argsort(-np.diff(block_at), kind="stable")
    essential = np.ones(len(terms), bool)
    essential[spread[np.cumsum(top[spread]) <= FREE]] = False
    return Index(
        terms, top, essential, block_at, segment[heads] // BLOCK, np.maximum.reduceat(score, heads),
        post_at, segment, score, np.array(item_of), verify,
    )


def search(index: Index, w: kernel.Words, hashes: np.ndarray) -> dict[tuple[int, int], float]:
    """(text, item) with the best score over the text's windows, for all that reach 1."""
    found: dict[tuple[int, int], float] = {}
    if not len(index.terms) or not len(hashes):
        return found
    steps = np.maximum(1, -(-w.counts // STEP))
    step_at = np.concatenate([[0], np.cumsum(steps)])
    known, place = index.known(hashes)
    doc = np.searchsorted(w.first, known, side="right") - 1
    step = step_at[doc] + (known - w.first[doc]) // STEP
    pairs = _distinct(step * len(index.terms) + place)
    step, term = pairs // len(index.terms), pairs % len(index.terms)
    total = np.bincount(step, index.top[term], step_at[-1])
    pair_at = np.searchsorted(step, np.arange(step_at[-1] + 1))
    owner = np.repeat(np.arange(len(steps)), steps)
    follows = np.zeros(len(total), bool)  # the next step is of the same text
    follows[:-1] = owner[1:] == owner[:-1]
    bound = total + np.where(follows, np.append(total[1:], 0), 0)
    windows = np.flatnonzero(bound >= SAFE)
    ends = np.where(follows[windows], windows + 2, windows + 1)
    # what a window opens: its terms, all their postings, a sum for every block
    opened = np.concatenate([[0], np.cumsum(1 + np.diff(index.post_at)[term])])
    opened = opened[pair_at[ends]] - opened[pair_at[windows]] + index.blocks
    for low, high in kernel.row_slices(np.concatenate([[0], np.cumsum(opened)]), CELLS):
        some = windows[low:high]
        at, row = kernel.ranges(pair_at[some], pair_at[ends[low:high]])
        both = _distinct(row * len(index.terms) + term[at])
        row, mine = both // len(index.terms), both % len(index.terms)
        # blocks: essential terms by their largest score in the block, the others by their top
        free = ~index.essential[mine]
        base = np.bincount(row[free], index.top[mine[free]], len(some))
        row_e, mine_e = row[~free], mine[~free]
        at, owner_e = kernel.ranges(index.block_at[mine_e], index.block_at[mine_e + 1])
        cells = np.bincount(row_e[owner_e] * index.blocks + index.block[at], index.block_top[at], len(some) * index.blocks)
        live = (cells.reshape(len(some), index.blocks) + base[:, None]) >= SAFE
        # full scores in the blocks that are left
        keep = live.any(axis=1)[row]
        row, mine = row[keep], mine[keep]
        if not len(row):
            continue
        at, owner_p = kernel.ranges(index.post_at[mine], index.post_at[mine + 1])
        # the cells of live blocks stand one after the other
        spot = np.cumsum(live.ravel()) - 1
        block = row[owner_p] * index.blocks + index.segment[at] // BLOCK
        hit = np.flatnonzero(live.ravel()[block])
        at, block = at[hit], spot[block[hit]]
        score = np.bincount(block * BLOCK + index.segment[at] % BLOCK, index.score[at], (spot[-1] + 1) * BLOCK)
        best = np.flatnonzero(score >= SAFE)
        where = np.flatnonzero(live)[best // BLOCK]
        windows_of, segment = where // index.blocks, where % index.blocks * BLOCK + best % BLOCK
        for window, part, value in zip(windows_of, segment, score[best], strict=True):
            pair = (int(owner[some[window]]), int(index.item_of[part]))
            found[pair] = max(found.get(pair, 0.0), float(value))
    return found


def share_found(grams: np.ndarray, there: np.ndarray) -> float:
    """The share of some distinct n-grams that occur; 1 where there are none to find."""
    if not len(grams):
        return 1.0
    return float(np.isin(grams, there, assume_unique=True).mean())


def _search_batches(shared, share: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = arrived(shared)
        for batch in batches:
            rows = []
            for low, _, w, hashes in _hashed(batch.column(1)):
                grams: dict[tuple[int, int], np.ndarray] = {}
                for (doc, n), score in sorted(search(index, w, hashes).items()):
                    item, size, question, answer_size, answer = index.items[n]
                    shares = []
                    for k, wanted in ((size, question), (answer_size, answer)):
                        if (doc, k) not in grams:
                            mine = hashes[w.first[doc] : w.first[doc + 1]]
                            grams[doc, k] = _grams(mine, k) if k else mine[:0]
                        shares.append(share_found(wanted, grams[doc, k]))
                    if min(shares) >= overlap:
                        rows.append((batch.column(0)[low + doc].as_py(), item, score * share, *shares))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc", "item", "score", "overlap", "answer_overlap"],
            )

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    share: float = 0.4,
    overlap: float = 0.5,
    index_words: int = 2_000_000,
) -> DataFrame:
    """One row per document row and item found in it: id, item, score, overlap, answer_overlap.

    score is the best window's BM25 score over the item's score for its own text; overlap is
    the share of the item's 5-word n-grams in the document (items with fewer words are one
    n-gram), answer_overlap the same for the answer, 1 without an answer. Words are runs
    without white space and ASCII punctuation, in lower case. Null and empty texts and items
    find nothing; rows without an id or item id are reported with null; repeated documents
    give repeated rows, repeated items too. Other columns are not read, so clashing names
    do no harm; an empty table on either side gives no rows.
    """
    check_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    check_columns(items, [item_col, item_text_col, *([answer_col] if answer_col else [])])
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col).alias("text"))
    wanted = items.select(
        F.col(item_col).cast("long"),
        text_of(item_text_col).alias("question"),
        (text_of(answer_col) if answer_col else F.lit("")).alias("answer"),
    )
    read = kept(wanted.mapInArrow(_read_items, ITEM).filter("words > 0"), "bench-items")
    parts = read.select("words", F.explode("segments.terms").alias("terms"))
    counted = parts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = kept(counted, "bench-terms")
    words = read.agg(F.sum("words")).first()[0] or 0
    segments = parts.count()
    indexes = max(1, -(-words // index_words))
    part = F.pmod(F.xxhash64("item", "grams"), F.lit(indexes))
    out = None
    for number in range(indexes):
        block = read.filter(part == number)
        terms = block.select(F.explode("segments.terms").alias("terms")).select(F.explode("terms").alias("term"))
        df = dict(counted.join(terms.distinct(), "term", "left_semi").select("term", "df").collect())
        index = build_index(block.collect(), df, segments, words / max(1, segments), share)
        hits = rows.mapInArrow(kernel.tidy(_search_batches(ship(spark, index), share, overlap)), FOUND)
        out = hits if out is None else out.unionByName(hits)
    return out.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", "overlap", "answer_overlap"
    )
