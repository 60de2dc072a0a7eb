"""Language by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary (byte-level, all single bytes
among them) a probability. A word's probability is the sum over all ways to cut it into
pieces of the product of their probabilities, worked out by a forward pass; a text's is the
product over its words. Probabilities come from expectation maximisation (forward and
backward passes) over the words of a sample of the labelled texts.

Scale: scoring is one pass over the documents without a shuffle. A task works out each
distinct word once per CACHE words, all words of a length together. The sample holds about
`sample_rows` texts per language (rows whose hashed id is under a limit) and the
`train_words` most frequent words of each; languages are as many as the labels name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm import kernel
from tablescout.llm.common import arrived, check_columns, fold, ship, small_batches, text_of

LONGEST = 16  # bytes of a piece
TABLE_BITS = 20
SLICE = 8 << 20
CACHE = 1_000_000
TOGETHER = 20_000  # words of a length at once
CUT = 256  # longer words are learned and scored in stretches of so many bytes
SAMPLE_ROWS = 2_000
TRAIN_WORDS = 10_000
ROUNDS = 6
FLOOR = 1e-3  # added to every piece's expected count


@dataclass
class Pieces:
    """The vocabulary as two hash tables, so that a piece is found in two steps."""

    first: np.ndarray
    second: np.ndarray
    hashes: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 where there is none."""
        shift = np.uint64(64 - TABLE_BITS)
        one = self.first[(h >> shift).astype(np.int64)]
        two = self.second[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        return np.where(self.hashes[one] == h, one, np.where(self.hashes[two] == h, two, -1))


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return kernel.mix((h ^ byte) * kernel.PRIME + kernel.STEP)


def load_pieces(vocabulary: bytes) -> Pieces:
    """Pieces of at most LONGEST bytes, and all single bytes."""
    tokens = {base64.b64decode(line.split()[0]) for line in vocabulary.splitlines() if line}
    tokens |= {bytes([b]) for b in range(256)}
    pieces = sorted(t for t in tokens if len(t) <= LONGEST)
    wide = np.zeros((len(pieces), LONGEST), np.uint8)
    size = np.array([len(p) for p in pieces])
    for i, p in enumerate(pieces):
        wide[i, : len(p)] = np.frombuffer(p, np.uint8)
    h = np.full(len(pieces), kernel.START, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONGEST):
            live = size > k
            h[live] = _step(h[live], wide[live, k].astype(np.uint64))
    first = np.zeros(1 << TABLE_BITS, np.int32)
    second = np.zeros(1 << TABLE_BITS, np.int32)
    at = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    number = np.arange(len(pieces))
    first[at] = number  # the last of those that meet stays
    left = number[first[at] != number]
    low = (h[left] & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    second[low] = left
    lost = set(left[second[low] != left].tolist())  # meets others in both tables: not used
    if any(size[i] == 1 for i in lost):
        raise ValueError("a single byte has no place in the piece tables")
    return Pieces(first, second, h)


def forward(rows: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability (rows x languages) of words of one length.

    table is pieces x languages. Sums are rescaled every eighth byte, so no length underflows.
    """
    n, length = rows.shape
    alpha = [np.ones((n, table.shape[1]))] + [np.zeros((n, table.shape[1])) for _ in range(length)]
    log = np.zeros((n, table.shape[1]))
    wide = rows.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            if i % 8 == 7:
                scale = alpha[i]
                log += np.log(scale)
                for j in range(i + 1, min(i + LONGEST, length + 1)):
                    alpha[j] /= scale
                alpha[i] = np.ones_like(scale)
            h = np.full(n, kernel.START, np.uint64)
            for k in range(min(LONGEST, length - i)):
                h = _step(h, wide[:, i + k])
                piece = pieces.find(h)
                live = np.flatnonzero(piece >= 0)
                if len(live) == n:
                    alpha[i + k + 1] += alpha[i] * table[piece]
                elif len(live):
                    alpha[i + k + 1][live] += alpha[i][live] * table[piece[live]]
    return log + np.log(alpha[length])


def expected(rows: np.ndarray, times: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words of one length that occur
    `times` (rows x languages) often."""
    n, length = rows.shape
    wide = rows.astype(np.uint64)
    found = {}
    with np.errstate(over="ignore"):
        for i in range(length):
            h = np.full(n, kernel.START, np.uint64)
            for k in range(min(LONGEST, length - i)):
                h = _step(h, wide[:, i + k])
                piece = pieces.find(h)
                live = np.flatnonzero(piece >= 0)
                if len(live):
                    found[i, i + k + 1] = live, piece[live]
    shape = (length + 1, n, table.shape[1])
    alpha, beta = np.zeros(shape), np.zeros(shape)
    alpha[0] = beta[length] = 1
    # sums are scaled every 8 bytes, as in forward; the logarithms of their scales
    none = np.zeros(shape[1:])
    up, down = [none] * (length + 1), [none] * (length + 1)
    for i in range(length):
        if i % 8 == 7:
            scale = alpha[i].copy()
            alpha[i : i + LONGEST] /= scale
            up[i:] = [up[i] + np.log(scale)] * (length + 1 - i)
        for j in range(i + 1, min(i + LONGEST, length) + 1):
            if (i, j) in found:
                live, piece = found[i, j]
                alpha[j, live] += alpha[i, live] * table[piece]
    for i in range(length - 1, -1, -1):
        for j in range(i + 1, min(i + LONGEST, length) + 1):
            if (i, j) in found:
                live, piece = found[i, j]
                beta[i, live] += table[piece] * beta[j, live]
        if (length - i) % 8 == 7:
            scale = beta[i].copy()
            beta[i : i + LONGEST] /= scale
            now = down[i] + np.log(scale)
            down[: i + LONGEST] = [now] * min(i + LONGEST, length + 1)
    whole = up[length] + np.log(alpha[length])
    out = np.zeros_like(table)
    for (i, j), (live, piece) in found.items():
        share = times[live] * np.exp(up[i][live] + down[j][live] - whole[live])
        mass = alpha[i, live] * table[piece] * beta[j, live] * share
        for lang in range(table.shape[1]):
            out[:, lang] += np.bincount(piece, mass[:, lang], len(table))
    return out


def by_length(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows of bytes) of words of one length at a time, each after a blank."""
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) > 0, [True]])) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True) if len(order) else []:
        size = int(length[order[a]])
        for low in range(a, b, max(1, min(TOGETHER, (1 << 21) // (size + 1)))):
            mine = order[low : min(b, low + max(1, min(TOGETHER, (1 << 21) // (size + 1))))]
            rows = np.full((len(mine), size + 1), 32, np.uint8)
            rows[:, 1:] = data[start[mine][:, None] + np.arange(size)]
            yield mine, rows


def stretches(w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, word) of all words, very long ones in stretches of CUT bytes."""
    start, length, whole = w.start, w.length, np.arange(len(w.start))
    if len(length) and length.max() > CUT:
        many = -(-length // CUT)
        whole = np.repeat(whole, many)
        shift = (np.arange(len(whole)) - np.repeat(np.cumsum(many) - many, many)) * CUT
        start, length = start[whole] + shift, np.minimum(CUT, length[whole] - shift)
    return start, length, whole


@dataclass
class Model:
    """Languages and their piece probabilities."""

    langs: list[str]
    pieces: Pieces
    table: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray | None = None

    def word_logs(self, w: kernel.Words) -> np.ndarray:
        """Log probabilities (words x languages); words seen before come from the cache."""
        start, length, whole = stretches(w)
        hashes = kernel.hash_words(kernel.Words(w.data, start, length, w.first, w.offsets))
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.values is None or len(self.known) > CACHE:
            self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))
        new = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
        logs = np.zeros((len(new), len(self.langs)))
        for mine, rows in by_length(w.data, start[at[new]], length[at[new]]):
            logs[mine] = forward(rows, self.pieces, self.table)
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known)
        self.known, self.values = known[order], np.concatenate([self.values, logs])[order]
        out = self.values[np.searchsorted(self.known, distinct)][back]
        if len(whole) == len(w.start):
            return out
        joined = np.zeros((len(w.start), len(self.langs)))
        np.add.at(joined, whole, out)
        return joined


def train(words: dict[str, dict[bytes, float]], pieces: Pieces) -> Model:
    """Expectation maximisation over word counts per language."""
    langs = sorted(words)
    number: dict[bytes, int] = {}
    for counts in words.values():
        for word in counts:
            number.setdefault(word, len(number))
    size = np.array([len(x) for x in number], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(number), np.uint8)
    times = np.zeros((len(number), len(langs)))
    for n, lang in enumerate(langs):
        for word, count in words[lang].items():
            times[number[word], n] = count
    table = np.full((len(pieces.hashes), len(langs)), 1 / len(pieces.hashes))
    for _ in range(ROUNDS if len(number) else 0):
        counts = np.full_like(table, FLOOR)
        for mine, rows in by_length(data, start, size):
            counts += expected(rows, times[mine], pieces, table)
        table = counts / counts.sum(axis=0)
    return Model(langs, pieces, table)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, kernel.Words]]:
    """Words of lower-cased texts without ASCII punctuation, by slices."""
    for low, high, data, offsets in kernel.texts(column, lower=True, most=SLICE):
        yield low, high, kernel.words_of(data, offsets, gaps=kernel.MARK)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count) of the texts of a task; very long words in stretches."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for low, _, w in _texts(batch.column(0)):
            start, length, whole = stretches(w)
            parts, doc = kernel.Words(w.data, start, length, w.first, w.offsets), w.doc[whole]
            hashes = kernel.hash_words(parts)
            for lang in sorted(set(langs[doc + low])) if len(doc) else []:
                mine = np.flatnonzero(langs[doc + low] == lang)
                _, at, count = np.unique(hashes[mine], return_index=True, return_counts=True)
                spelled = [parts.word(i) for i in mine[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(spelled, pa.binary()), pa.array(count, pa.int64())],
                    ["lang", "word", "n"],
                )


def fit(labelled: DataFrame, pieces: Pieces, sample_rows: int, train_words: int) -> Model:
    """A model of labelled texts (id, text, lang)."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces.hashes), 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample_rows / n)])
    spread = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(spread < F.element_at(share, F.col("lang"))).select("text", "lang")
    counted = sample.mapInArrow(_count_words, "lang string, word binary, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # at most sample_rows texts per language are behind this window
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words: dict[str, dict[bytes, float]] = {lang: {} for lang in sizes}
    for r in counted.withColumn("rank", rank).filter(F.col("rank") <= train_words).collect():
        words[r["lang"]][bytes(r["word"])] = float(r["n"])
    return train(words, pieces)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = arrived(shared)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for low, high, w in _texts(batch.column(3)):
                logs = model.word_logs(w) if model.langs else np.zeros((len(w.start), 0))
                total = np.stack([kernel.sums(x, w.first) for x in logs.T], axis=1) if model.langs else None
                for i in range(high - low):
                    if total is None or not letters[low + i]:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    # the posterior, flattened by the root of the number of words
                    odds = total[i] / np.sqrt(max(1, w.first[i + 1] - w.first[i]))
                    odds = np.exp(odds - odds.max())
                    best = int(odds.argmax())
                    names.append(model.langs[best])
                    scores.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "held_out", "lang_pred", "score"],
            )

    return run


def predict_language(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_fold: int = 1,
    sample_rows: int = SAMPLE_ROWS,
    train_words: int = TRAIN_WORDS,
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Documents whose crc32(id) modulo `folds` is `held_fold`, and those without a language,
    are not learned from; id, language and other columns make no prediction. A text that is
    null or without a letter is "und" with score 0, as are all where no language is known.
    Equal scores go to the language that comes first. Ids may repeat or be null; an empty
    table gives no rows.
    """
    check_columns(docs, [id_col, text_col, lang_col])
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        pieces = load_pieces(file.read())
    held = fold(id_col, folds) == held_fold
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held).select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model = fit(labelled, pieces, sample_rows, train_words)
    shared = ship(docs.sparkSession, model)
    rows = docs.select(
        F.col(id_col).alias("id"),
        held.alias("held_out"),
        text_of(text_col).rlike(r"\p{L}").alias("letter"),
        text_of(text_col).alias("text"),
    )
    schema = rows.select("id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(shared), schema).withColumnRenamed("id", id_col)
