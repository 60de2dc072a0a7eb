"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on block-max indexes.

Terms are words and word beginnings of 4, 5 and 6 bytes (lower case, without ASCII
punctuation), hashed to 2^20 places. A document is its TF-IDF vector over all its terms, of
unit length; none is left out. The idf of a place comes from all labelled rows; it is
raised by 1 + the logarithm of how many times as often the place is in toxic as in clean
rows, where that is more than once (shares of each class, so that the mix of labels does not
matter; SMOOTH rows of the mean share are added to both).

The index holds examples, halved again and again so that like ones stand together, in blocks of BLOCK. What
a query shares with an example in the most widespread terms (in WIDE of the examples, at most
MOST_WIDE terms) comes from matrix products of many queries and a block; the postings of rare terms (in
under RARE examples) are few and added as they are. The other terms have their
largest weight in each block, as have the most widespread; a query adds up the block bounds, opens the blocks of the
largest bounds, then the others but for those whose bound does not reach its k-th best among
these. Bounds are in single precision, with SLACK for rounding; the cosines are sums over all
terms in double precision: exact. The k nearest vote with their cosines; a logistic curve
fitted on the examples, each without itself, turns the vote into a probability. Equal
cosines prefer the smaller id. The nearest examples are the evidence.

Scale: counts leave a task as one compressed table. The index holds about `sample_rows`
examples per class (rows whose hashed id is under a limit); their vectors are broadcast, compressed,
and a worker makes the lists once. The votes of the examples come from tasks too. Scoring is one
pass over the documents without a shuffle, and equal vectors of a task are searched once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm import kernel
from tablescout.llm.common import arrived, broadcast_if_small, check_columns, fold, kept, ship, small_batches, text_of

BITS = 20
SIZE = 1 << BITS
CHUNKS = 64
BEGINNINGS = (4, 5, 6)
SMOOTH = 1.0
SAMPLE_ROWS = 3_000
BLOCK = 64
OPENED = 4  # blocks before the k-th best is known
WIDE = 1 / 20
MOST_WIDE = 1_024
RARE = 16  # examples; terms of fewer have no largest weights by block
SLACK = 2e-4  # above the rounding of bounds, which are in single precision
CALIBRATED = 500
TOGETHER = 256  # queries searched side by side
LEADING = 1_024  # terms by which examples are put in order
POWERS = 6
NEAREST = 15
EVIDENCE = 3
CACHE = 100_000


def places(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, places of all terms, offsets) of slices; repeats stay."""
    for low, high, data, offsets in kernel.texts(column, lower=True):
        w = kernel.words_of(data, offsets, gaps=kernel.MARK)
        doc = w.doc
        found, owner = [kernel.hash_words(w)], [doc]
        for size in BEGINNINGS:
            longer = np.flatnonzero(w.length > size)
            start = kernel.Words(w.data, w.start[longer], np.full(len(longer), size, np.int64), w.first, w.offsets)
            found.append(kernel.hash_words(start, size))
            owner.append(doc[longer])
        at = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        yield low, high, at[order], np.searchsorted(owner[order], np.arange(high - low + 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class (columns text, label) have a term."""
    counts = np.zeros(2 * SIZE, np.uint32)
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, high, at, offsets in places(batch.column(0)):
            for i in range(high - low):
                mine = np.unique(at[offsets[i] : offsets[i + 1]])
                counts[labels[low + i] * SIZE + mine] += 1
    if counts.any():
        yield kernel.pack_counts(counts, CHUNKS)


@dataclass
class Vocabulary:
    """The weight of every place."""

    weight: np.ndarray

    def vectors(self, at: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors (places, weights) of texts; without a term both are empty."""
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            terms, times = np.unique(at[a:b], return_counts=True)
            weight = (1 + np.log(times)) * self.weight[terms]
            out.append((terms, weight / np.sqrt((weight * weight).sum()) if len(terms) else weight))
        return out


def weigh_terms(counts: np.ndarray, rows: tuple[int, int]) -> Vocabulary:
    """The idf of every place, raised where it speaks for the label."""
    clean, toxic = counts[:SIZE].astype(float), counts[SIZE:].astype(float)
    n = float(sum(rows))
    mean = SMOOTH / n
    lift = (toxic / rows[1] + mean) / (clean / rows[0] + mean)
    # a place of all rows keeps a weight
    return Vocabulary(np.log((n + 1) / (clean + toxic + 0.5)) * (1 + np.log(np.maximum(lift, 1))))


@dataclass
class Index:
    """Examples by position, in blocks of BLOCK.

    Terms are numbered anew, `number[place]` (-1: no example has it): first the widespread ones,
    with a matrix of weights for each block, `wide`, and a row of largest weights by block,
    `wide_top`; then those with such a row in `top` and a row of `post_at`, where its postings
    of each block begin (those of term t in blocks b to c are post_at[t, b] to post_at[t, c + 1],
    sorted by position); then the rare ones, whose postings are `rare_at[t]` up.
    """

    ids: np.ndarray
    labels: np.ndarray
    blocks: int
    number: np.ndarray
    wide: np.ndarray
    wide_top: np.ndarray
    top: np.ndarray
    post_at: np.ndarray
    rare_at: np.ndarray
    position: np.ndarray
    weight: np.ndarray

    def known(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A query's terms that examples have, by their numbers, ascending."""
        number = self.number[terms]
        order = np.argsort(number, kind="stable")
        order = order[np.searchsorted(number[order], 0) :]
        return number[order], weights[order]

    def search(
        self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest examples (cosine above 0) of every vector, best
        first; `without` names an example for each vector that does not count."""
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        if not len(self.ids):
            return out
        queries = [self.known(*v) for v in vectors]
        dense = np.zeros((len(vectors), len(self.wide_top)))
        for row, (terms, weights) in zip(dense, queries, strict=True):
            n = np.searchsorted(terms, dense.shape[1])
            row[terms[:n]] = weights[:n]
        bound = dense.astype(np.float32) @ self.wide_top
        # queries that share their likeliest block open much the same blocks
        order = np.argsort(bound.argmax(axis=1), kind="stable")
        for low in range(0, len(order), TOGETHER):
            some = order[low : low + TOGETHER]
            skip = [without[i] if without else -1 for i in some]
            for i, found in zip(some, self._nearest([queries[i] for i in some], dense[some], bound[some], k, skip), strict=True):
                out[i] = found
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one vector."""
        return self.search([(terms, weights)], k)[0]

    def _add(self, to: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> None:
        """Add the postings of some ranges times the weights of their terms."""
        many = ends - starts
        some = np.flatnonzero(many)
        many, starts = many[some], starts[some]
        at = np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many)
        to += np.bincount(self.position.take(at), self.weight.take(at) * np.repeat(weights[some], many), len(to))

    def _nearest(
        self, queries: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, bound: np.ndarray, k: int, without: list[int]
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Searches some queries together; `bound` has the block bounds of their widespread terms."""
        found = np.zeros((len(queries), self.blocks * BLOCK))
        middle, first = [], np.zeros(bound.shape, bool)
        for i, (terms, weights) in enumerate(queries):
            a, b = np.searchsorted(terms, [dense.shape[1], dense.shape[1] + len(self.top)])
            rare = terms[b:] - dense.shape[1] - len(self.top)
            self._add(found[i], self.rare_at[rare], self.rare_at[rare + 1], weights[b:])
            row = terms[a:b] - dense.shape[1]
            bound[i] += weights[a:b].astype(np.float32) @ self.top[row] + found[i].reshape(-1, BLOCK).max(axis=1)
            first[i, np.argsort(-bound[i], kind="stable")[:OPENED]] = True
            middle.append((self.post_at[row], weights[a:b]))
        # the blocks of the largest bounds first, then all whose bound reaches the k-th best of those
        least = np.zeros(len(queries))
        for chosen in (first, ~first):
            opened = chosen & (bound > 0) & (bound >= least[:, None] - SLACK)
            for block in np.flatnonzero(opened.any(axis=0)):
                mine = np.flatnonzero(opened[:, block])
                found[mine, block * BLOCK : (block + 1) * BLOCK] += dense[mine] @ self.wide[block]
            edges = np.diff(opened, axis=1, prepend=False, append=False)
            for i, (starts, weights) in enumerate(middle):
                # neighbouring blocks are one range of a term's postings
                edge = np.flatnonzero(edges[i])
                low, high = starts[:, edge[::2]], starts[:, edge[1::2]]
                self._add(found[i], low.ravel(), high.ravel(), np.repeat(weights, low.shape[1]))
                if without[i] >= 0:
                    found[i, without[i]] = 0
                if chosen is first:
                    sums = found[i].reshape(-1, BLOCK)[opened[i]].ravel()
                    least[i] = np.partition(sums, -k)[-k] if k <= len(sums) else 0.0
        for sums, border in zip(found, least, strict=True):
            best = np.flatnonzero((sums > 0) & (sums >= border - SLACK))
            cosine = sums[best]
            order = np.lexsort((self.ids[best], -np.round(cosine, 12)))[:k]
            yield best[order], cosine[order]


@dataclass
class Examples:
    """Labelled vectors in the order of the index, as they travel: compressed, without its lists."""

    ids: np.ndarray
    labels: np.ndarray
    packed: tuple[bytes, ...]

    def unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each example has, and all places and weights, one example after the other."""
        kinds = np.int64, np.int32, float
        return tuple(np.frombuffer(zlib.decompress(x), kind) for x, kind in zip(self.packed, kinds, strict=True))


def arrange(ids: np.ndarray, labels: np.ndarray, size: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Examples:
    """Examples in an order in which like ones stand together.

    They are halved along the direction in which their weights of the most widespread terms
    differ most, and the halves again, down to a block.
    """
    rows = np.bincount(terms, minlength=1)
    leading = np.argsort(-rows, kind="stable")[:LEADING]
    number = np.full(len(rows), -1)
    number[leading] = np.arange(len(leading))
    matrix = np.zeros((len(ids), len(leading)), np.float32)
    known = np.flatnonzero(number[terms] >= 0)
    matrix[np.repeat(np.arange(len(ids)), size)[known], number[terms[known]]] = weights[known]
    order = _halved(matrix, np.lexsort((ids, labels)))
    at = np.concatenate([[0], np.cumsum(size)])
    place, _ = kernel.ranges(at[order], at[order + 1])
    parts = size[order], terms[place].astype(np.int32), weights[place].astype(float)
    return Examples(ids[order], labels[order], tuple(zlib.compress(x.tobytes(), 1) for x in parts))


def _halved(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if len(rows) <= BLOCK:
        return rows
    part = matrix[rows] - matrix[rows].mean(axis=0)
    way = part[np.argmax((part * part).sum(axis=1))]
    for _ in range(POWERS):
        way = part.T @ (part @ way)
        way /= np.linalg.norm(way) + 1e-9
    rows = rows[np.argsort(part @ way, kind="stable")]
    del part
    half = -(-len(rows) // (2 * BLOCK)) * BLOCK  # whole blocks
    return np.concatenate([_halved(matrix, rows[:half]), _halved(matrix, rows[half:])])


def build_index(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], bound: int) -> Index:
    """The index of some vectors, whose places are below `bound`."""
    size = np.array([len(t) for t, _ in vectors], np.int64)
    terms = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in vectors]])
    weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
    return lists_of(arrange(ids, labels, size, terms, weights), bound)


def lists_of(examples: Examples, bound: int) -> Index:
    """The lists of an index over examples whose places are below `bound`."""
    size, place, weight = examples.unpacked()
    count = len(examples.ids)
    blocks = max(1, -(-count // BLOCK))
    rows = np.bincount(place, minlength=bound)
    # the most frequent terms first; equal ones by their places
    by_rows = np.argsort(-rows, kind="stable")[: np.count_nonzero(rows)].astype(np.int32)
    number = np.full(bound, -1, np.int32)
    number[by_rows] = np.arange(len(by_rows), dtype=np.int32)
    rows = rows[by_rows]
    n_wide = min(MOST_WIDE, np.count_nonzero(rows > WIDE * count))
    n_top = max(0, np.count_nonzero(rows >= RARE) - n_wide)
    term = number[place]
    del place
    position = np.repeat(np.arange(count, dtype=np.int32), size)
    spread = term < n_wide
    wide = np.zeros((blocks, n_wide, BLOCK))
    wide[position[spread] // BLOCK, term[spread], position[spread] % BLOCK] = weight[spread]
    rest = np.flatnonzero(~spread)
    rest = rest[np.argsort(term[rest], kind="stable")]
    listed, position, weight = term[rest] - n_wide, position[rest], weight[rest]
    del rest, spread, term
    split = np.searchsorted(listed, n_top)
    cell = listed[:split] * np.int64(blocks) + position[:split] // BLOCK
    post_at = np.zeros((n_top, blocks + 1), np.int32)
    post_at[:, 1:] = np.cumsum(np.bincount(cell, minlength=n_top * blocks)).reshape(n_top, blocks)
    post_at[1:, 0] = post_at[:-1, -1]
    top = np.zeros(n_top * blocks, np.float32)
    heads = np.flatnonzero(np.diff(cell, prepend=-1))
    if split:
        top[cell[heads]] = np.maximum.reduceat(weight[:split], heads)
    rare_at = np.searchsorted(listed[split:], np.arange(n_top, len(rows) - n_wide + 1)) + split
    return Index(
        examples.ids, examples.labels, blocks, number, wide, wide.max(axis=2).T.astype(np.float32),
        top.reshape(n_top, blocks), post_at, rare_at, position.astype(np.intp), weight,
    )


@dataclass
class Model:
    """What travels to the tasks; `index` is made there, once a worker."""

    vocabulary: Vocabulary
    examples: Examples
    prior: float

    @cached_property
    def index(self) -> Index:
        return lists_of(self.examples, SIZE)

    def ready(self) -> Model:
        """The model with its lists and without the vectors, which scoring does not need."""
        if self.examples.packed:
            _, self.examples = self.index, replace(self.examples, packed=())
        return self

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """The neighbours' labels weighted by their cosines, pulled a little to the middle."""
        return float(((2 * self.examples.labels[found] - 1) * cosine).sum() / (cosine.sum() + 0.5))

    def score(self, found: np.ndarray, cosine: np.ndarray, curve: tuple[float, float]) -> float:
        if not len(found):
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(curve[0] * self.vote(found, cosine) + curve[1], -30, 30))))


def _model(shared) -> Model:
    """The broadcast model, unpacked once by a worker that serves many tasks."""
    holder = shared.value
    if isinstance(holder[0], bytes):
        holder[0] = pickle.loads(holder[0])
    return holder[0]


def _rows(vocabulary_shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = arrived(vocabulary_shared)
        for batch in batches:
            terms, weights = [], []
            for _, _, at, offsets in places(batch.column(2)):
                for t, w in vocabulary.vectors(at, offsets):
                    terms.append(t.astype(np.int32).tobytes())
                    weights.append(w.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(terms, pa.binary()), pa.array(weights, pa.binary())],
                ["id", "label", "terms", "weights"],
            )

    return run


def _votes(shared):
    """(position, vote) of examples, each by its nearest others; positions come as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        size, terms, weights = model.examples.unpacked()
        at = np.concatenate([[0], np.cumsum(size)])
        for batch in batches:
            mine = [p for p in batch.column(0).to_pylist() if size[p]]
            vectors = [(terms[at[p] : at[p + 1]], weights[at[p] : at[p + 1]]) for p in mine]
            found = model.index.search(vectors, NEAREST, without=mine)
            votes = [(p, model.vote(f, c)) for p, (f, c) in zip(mine, found, strict=True) if len(f)]
            columns = [pa.array([v[0] for v in votes], pa.int64()), pa.array([v[1] for v in votes], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["position", "vote"])

    return run


def fit(labelled: DataFrame, sample_rows: int) -> tuple[Broadcast, tuple[float, float]]:
    """A model of labelled rows (id, text, label 0 or 1), broadcast, and its logistic curve.

    The driver holds the compressed vectors of the sample; lists and votes are made in tasks.
    """
    spark = labelled.sparkSession
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    rows = (sizes.get(0, 0), sizes.get(1, 0))
    counts = kernel.total_counts(
        labelled.select("text", "label").mapInArrow(_counts, "chunk int, counts binary"), 2 * SIZE, CHUNKS
    )
    vocabulary = weigh_terms(counts, (max(rows[0], 1), max(rows[1], 1)))
    spread = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, sample_rows / max(rows[1], 1)).otherwise(sample_rows / max(rows[0], 1))
    sample = labelled.filter(spread < share).select(F.col("id").cast("long"), "label", "text")
    got = sample.mapInArrow(_rows(ship(spark, vocabulary)), "id long, label int, terms binary, weights binary")
    # the same model for any order of rows
    got = got.toArrow().sort_by([(c, "ascending") for c in ("id", "label", "terms", "weights")]).combine_chunks()
    ids = got["id"].fill_null(-1).to_numpy()
    labels = got["label"].to_numpy().astype(np.int64)
    size = pc.binary_length(got["terms"]).to_numpy().astype(np.int64) // 4
    terms, weights = (np.frombuffer(b"".join(got[c].to_pylist()), kind) for c, kind in (("terms", np.int32), ("weights", float)))
    del got
    examples = arrange(ids, labels, size, terms, weights)
    # a row stands for as many as its class has per row of the sample
    labels, size = examples.labels, examples.unpacked()[0]
    weight = np.array([rows[y] / max(1, (labels == y).sum()) for y in (0, 1)])[labels]
    seen = weight[size == 0].sum()
    prior = float((weight * labels)[size == 0].sum() + 0.5 * rows[1] / max(1, sum(rows))) / (seen + 0.5) if len(ids) else 0.0
    shared = spark.sparkContext.broadcast([cloudpickle.dumps(Model(vocabulary, examples, prior))])
    # tasks of at least CALIBRATED examples
    tasks = max(1, min(spark.sparkContext.defaultParallelism, len(ids) // CALIBRATED))
    votes = spark.range(0, len(ids), 1, tasks).mapInArrow(_votes(shared), "position long, vote double")
    votes = votes.toArrow().sort_by("position")
    known = votes["position"].to_numpy()
    curve = (4.0, 0.0)
    if len(set(labels[known])) == 2:
        curve = kernel.platt(votes["vote"].to_numpy(), labels[known], weight[known] / weight[known].mean())
    return shared, curve


def _score(shared, curve: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared).ready()
        cache: dict[bytes, tuple[float, list[int], list[float]]] = {}
        for batch in batches:
            out = []
            for _, _, at, offsets in places(batch.column(2)):
                vectors = model.vocabulary.vectors(at, offsets)
                keys = [blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest() for t, w in vectors]
                if len(cache) >= CACHE:
                    cache.clear()
                new = {key: v for key, v in zip(keys, vectors, strict=True) if key not in cache}
                for key, (found, cosine) in zip(new, model.index.search(list(new.values()), NEAREST), strict=True):
                    few = model.examples.ids[found[:EVIDENCE]].tolist()
                    cache[key] = model.score(found, cosine, curve), few, cosine[:EVIDENCE].tolist()
                out += [cache[key] for key in keys]
            columns = [
                pa.array([x[0] for x in out], pa.float64()),
                pa.array([x[1] for x in out], pa.list_(pa.int64())),
                pa.array([x[2] for x in out], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *columns], ["id", "held_out", "score", "evidence", "cosines"]
            )

    return run


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence (ids), cosines.

    Labels of documents whose crc32(id) modulo `folds` is `held_fold` are never learned from;
    only the text makes a score. Texts without a term, such as null and empty ones, and
    those that share none with an example get the share of toxic rows among the examples
    without one, and no evidence.
    Labels other than 0 and 1, null labels and labels without a document are ignored; a
    document labelled twice is two examples. Ids may repeat or be null (as evidence: -1).
    Without labelled rows all scores are 0. An empty table of documents gives no rows.
    """
    check_columns(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    check_columns(labels, [id_col, label_col])
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    learn = learn.filter(F.col("label").isin(0, 1) & (fold("id", folds) != held_fold))
    learn = broadcast_if_small(learn, learn.count())
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    labelled = kept(texts.join(learn, "id").select("id", "text", "label"), "toxic-labelled")
    shared, curve = fit(labelled, sample_rows)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (fold(id_col, folds) == held_fold).alias("held_out"),
        text_of(text_col).alias("text"),
    )
    kind = rows.drop("text").selectExpr("*", "0d as score", "array(0L) as evidence", "array(0d) as cosines").schema
    return rows.mapInArrow(_score(shared, curve), kind).select(
        F.col("id").alias(id_col),
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
        "cosines",
    )
