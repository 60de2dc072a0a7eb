"""Quality classifier: a linear SVM on naive Bayes features.

Features are n-grams as indicators: byte trigrams of the whole text (case kept) and one to
three word shapes in a row (case, digits, marks, length, whether the word repeats the one
before), hashed to 2^18 places. Every indicator is scaled by the log ratio of its smoothed
counts in the two classes, over all labelled rows; documents have unit length. A hinge-loss
linear model is fitted by dual coordinate descent on a bounded sample of the labelled rows,
and turned into probabilities by a logistic curve on the part of the sample left out.

Scale: counts leave a task as one compressed table, whatever its number of rows. The sample
has about `sample_rows` rows per class (rows whose hashed id is under a limit). Scoring is
one pass over the documents without a shuffle; the model is 2^18 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm import kernel
from tablescout.llm.common import arrived, broadcast_if_small, check_columns, fold, kept, ship, small_batches, text_of

BITS = 18
SIZE = 1 << BITS
CHUNKS = 16
SAMPLE_ROWS = 4_000
SLICE = 512 << 10  # bytes of text at once; features take some 45 times as much
SMOOTH = 1.0

# the class of a byte: 0 other marks, 1 a-z, 2 A-Z, 3 digits, 4 beyond ASCII, 5 . , ; : ' -
KIND = np.zeros(256, np.uint64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 4
KIND[[44, 46, 58, 59, 39, 45]] = 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of every text, with offsets."""
    w = kernel.words_of(data, offsets, lower=False)
    mask = np.uint64(SIZE - 1)
    with np.errstate(over="ignore"):
        wide = data.astype(np.uint64)
        grams = np.zeros(len(data), np.uint64)
        if len(data) > 2:
            grams[:-2] = kernel.mix(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) & mask
        # trigrams that reach into the next text are cut off below
        ends = np.maximum(offsets[1:] - 2, offsets[:-1])
        kinds = KIND[w.data] if len(w.data) else KIND[:0]
        size = w.length.astype(np.uint64)
        shape = np.zeros(len(size), np.uint64)
        if len(size):
            last = w.start + w.length - 1
            upper = np.add.reduceat(kinds == 2, w.start)
            # reduceat sums up to the next word, white space has kind 0
            marks = np.add.reduceat((kinds == 0) & ~kernel.SPACE[w.data], w.start)
            hashes = kernel.hash_words(w)
            again = np.zeros(len(size), bool)
            again[1:] = hashes[1:] == hashes[:-1]
            again[w.first[:-1][w.counts > 0]] = False
            for part in (
                kinds[w.start], kinds[last], upper == w.length, np.minimum(upper, 2),
                np.minimum(marks, 3), np.minimum(size, 12) // 3, again,
            ):
                shape = shape * np.uint64(8) + part.astype(np.uint64)
        shape = kernel.mix(shape + kernel.STEP)
        two, three = shape.copy(), shape.copy()
        two[1:] = kernel.mix(shape[:-1] * kernel.MIX1 + shape[1:])
        three[2:] = kernel.mix(two[1:-1] * kernel.MIX1 + shape[2:])
    out, counts = [], []
    for i in range(len(offsets) - 1):
        a, b = w.first[i], w.first[i + 1]
        mine = np.concatenate([grams[offsets[i] : ends[i]], shape[a:b] & mask, two[a + 1 : b] & mask, three[a + 2 : b] & mask])
        mine = np.unique(mine.astype(np.int32))
        out.append(mine)
        counts.append(len(mine))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


@dataclass
class Model:
    """Margin of a text: sum of `weight` over its features / sqrt(sum of `square`) + bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def margins(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(kernel.sums(self.square[found], offsets), 1e-12))
        return kernel.sums(self.weight[found], offsets) / size + self.bias

    def score(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(found, offsets) + self.b, -30, 30)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, cost: np.ndarray, rounds: int = 30) -> Model:
    """Hinge loss by dual coordinate descent; rows are feature numbers, label is +1 or -1."""
    scaled = []
    for r in rows:
        x = ratio[r]
        scaled.append(x / max(np.sqrt((x * x).sum()), 1e-6))
    weight, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    diagonal = np.array([(x * x).sum() + 1.0 for x in scaled])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            r, x, y = rows[i], scaled[i], label[i]
            gradient = y * (x @ weight[r] + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weight[r] += step * x
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return Model(weight * ratio, ratio * ratio, bias)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class (columns text, label) have a feature."""
    counts = np.zeros(2 * SIZE, np.uint32)
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, high, data, offsets in kernel.texts(batch.column(0), most=SLICE):
            found, ends = features(data, offsets)
            owner = np.repeat(labels[low:high], np.diff(ends)).astype(np.int64)
            counts += np.bincount(owner * SIZE + found, minlength=2 * SIZE).astype(np.uint32)
    if counts.any():
        yield kernel.pack_counts(counts, CHUNKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, features, label) of every text."""
    for batch in batches:
        for low, high, data, offsets in kernel.texts(batch.column(1), most=SLICE):
            found, ends = features(data, offsets)
            packed = [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids, labels = batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low)
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary()), labels], ["id", "features", "label"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of labelled rows (id, text, label 0 or 1).

    Without rows of both classes all texts get the score 0.5 (none) or near the class seen.
    """
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        side = {0: -3.0, 1: 3.0}.get(next(iter(sizes), -1), 0.0)
        return Model(np.zeros(SIZE), np.zeros(SIZE), side)
    both = kernel.total_counts(labelled.select("text", "label"), 2 * SIZE, CHUNKS, _counts)
    low, high = both[:SIZE] + SMOOTH, both[SIZE:] + SMOOTH
    ratio = np.log((high / (sizes[1] + 2 * SMOOTH)) / (low / (sizes[0] + 2 * SMOOTH)))
    ratio[both[:SIZE].astype(np.int64) + both[SIZE:] < 3] = 0.0  # features of one or two rows say little
    spread = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, sample_rows / sizes[1]).otherwise(sample_rows / sizes[0])
    sample = labelled.filter(spread < share).select(F.col("id").cast("string"), "text", "label")
    got = sample.mapInArrow(kernel.tidy(_rows), "id string, features binary, label int").collect()
    # the same model for any order of rows
    got.sort(key=lambda r: (r["id"] or "", r["label"], r["features"]))
    rows = [np.frombuffer(r["features"], np.int32) for r in got]
    label = np.array([r["label"] for r in got])
    held = np.arange(len(rows)) % 5 == 0
    # a row stands for as many as its class has per row of the sample
    per_class = {k: sizes[k] / max(1, (label == k).sum()) for k in (0, 1)}
    weight = np.array([per_class[k] for k in label])
    cost = np.ones(len(rows))
    sign = np.where(label == 1, 1.0, -1.0)
    train = np.flatnonzero(~held)
    model = descend([rows[i] for i in train], ratio, sign[train], cost[train])
    test = [rows[i] for i in np.flatnonzero(held)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in test], dtype=np.int64)])
    margin = model.margins(np.concatenate(test) if test else np.zeros(0, np.int32), ends)
    if len(set(label[held])) == 2:
        model.a, model.b = kernel.platt(margin, label[held], weight[held] / weight[held].mean())
    return model


def _score(shared, with_text: bool):
    """The columns of a batch and the score of its last one, a few MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = arrived(shared)
        for batch in batches:
            kept_columns = batch.num_columns - (0 if with_text else 1)
            names = [*batch.schema.names[:kept_columns], "score"]
            for low, high, data, offsets in kernel.texts(batch.column(batch.num_columns - 1), most=SLICE):
                columns = [c.slice(low, high - low) for c in batch.columns[:kept_columns]]
                scores = pa.array(model.score(*features(data, offsets)))
                yield pa.RecordBatch.from_arrays([*columns, scores], names)

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_fold: int = 2,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, and the columns named in `keep`.

    Labels of documents whose crc32(id) modulo `folds` is `held_fold` are never learned from.
    Only the text makes a score; null counts as empty, and an empty text gets the score of a
    text without features. Labels other than 0 and 1, null labels and labels without a
    document are ignored; a document labelled twice counts twice. Ids may repeat or be null.
    An empty table of documents gives no rows.
    """
    check_columns(docs, [id_col, text_col, *keep])
    small_batches(docs.sparkSession)
    check_columns(labels, [id_col, label_col])
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    learn = learn.filter(F.col("label").isin(0, 1) & (fold("id", folds) != held_fold))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # labels are narrow: they travel to the texts while they are few
    learn = broadcast_if_small(learn, learn.count())
    labelled = kept(texts.join(learn, "id").select("id", "text", "label"), "quality-labelled")
    shared = ship(docs.sparkSession, fit(labelled, sample_rows))
    # the text travels once
    others = [c for c in keep if c not in (id_col, text_col)]
    with_text = text_col in keep
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(others)],
        F.col(id_col).alias("id"),
        (fold(id_col, folds) == held_fold).alias("held_out"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    schema = (rows if with_text else rows.drop("text")).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(kernel.tidy(_score(shared, with_text)), schema).select(
        *[F.col(f"k{n}").alias(c) for n, c in enumerate(others)],
        *([F.col("text").alias(text_col)] if with_text else []),
        F.col("id").alias(id_col),
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
