"""Words, hashes and sets of whole Arrow text columns with numpy, a few MB at a time."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
LONG_WORD = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# every ASCII byte that is neither a letter nor a digit
MARK = np.ones(256, bool)
MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PRIME = np.uint64(0x100000001B3)
START = np.uint64(0xCBF29CE484222325)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Return memory that is free to the system; a Python worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, but for the free memory that its worker would keep after the task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


@dataclass
class Words:
    """The words of some texts: data holds their bytes, first[i]:first[i+1] are text i's words."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each text's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, but of one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def words_of(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACE
) -> Words:
    """Split every text at the gap bytes; words never span two texts."""
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), offsets)
    inside = ~gaps[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = inside[tails]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    return Words(data, start, length, np.searchsorted(start, offsets), offsets)


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.uint64)
    order = np.argsort(-w.length, kind="stable")
    start, length = w.start[order], w.length[order]
    h = np.full(n, START ^ np.uint64(seed), np.uint64)
    reach = np.searchsorted(-length, -np.arange(1, min(int(length[0]), LONG_WORD) + 1), side="right")
    with np.errstate(over="ignore"):
        for k, m in enumerate(reach):
            h[:m] = (h[:m] ^ w.data[start[:m] + k]) * PRIME
        h = mix(h + length.astype(np.uint64))
    for i in range(int(np.searchsorted(-length, -LONG_WORD, side="left"))):
        if length[i] > LONG_WORD:
            whole = w.data[start[i] : start[i] + length[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8, salt=b"%d" % seed).digest(), "little")
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


def shingles(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words with their offsets per text.

    A text with fewer words gives one value, that of its whole sequence; a text without
    words gives none.
    """
    counts = w.counts
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(offsets[-1], np.uint64)
    at = np.repeat(w.first[:-1] - offsets[:-1], many) + np.arange(offsets[-1])
    run = np.repeat(np.minimum(counts, size), many)
    with np.errstate(over="ignore"):
        if len(at):
            out[:] = run.astype(np.uint64)
        for k in range(size):
            live = slice(None) if k == 0 else np.flatnonzero(run > k)
            out[live] = mix(out[live] * STEP + hashes[at[live] + k])
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, without repeats."""
    parts = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(counts)):
        part = values[offsets[i] : offsets[i + 1]]
        if len(part) > 1:
            part = np.sort(part)
            new = np.empty(len(part), bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            part = part[new]
        counts[i] = len(part)
        parts.append(part)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(counts)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 where there are none."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    with np.errstate(over="ignore"):
        return total[offsets[1:]] - total[offsets[:-1]]


def least(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest of each text's values; 0 where there are none."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.minimum.reduceat(values, offsets[:-1][some])
    return out


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column of 64-bit values."""
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64))
    )


def texts(
    column: pa.Array, lower: bool = False, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of a text column.

    With `lower` a slice is put into lower case, all letters of Unicode.
    """
    data, offsets = flat(column)
    for low, high in row_slices(offsets, most):
        if lower:
            yield low, high, *flat(pc.utf8_lower(column.slice(low, high - low)))
        else:
            yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def pack_counts(counts: np.ndarray, chunks: int) -> pa.RecordBatch:
    """A count table (unsigned, 32 bits) in compressed chunks: rows (chunk, counts)."""
    parts = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(counts, chunks)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(chunks), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"]
    )


def add_counts(width: int, count: Callable | None = None):
    """Sums the chunks that a task meets or, with `count`, that it makes of the batches; `width` counts are in one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in count(batches) if count else batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = pa.decompress(packed.as_buffer(), width * 4, "zstd")
                add = np.frombuffer(raw, np.uint32).astype(np.uint64)
                total[chunk] = total[chunk] + add if chunk in total else add
        for chunk, table in total.items():
            packed = pa.compress(np.minimum(table, 0xFFFFFFFF).astype(np.uint32).tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "counts"]
            )

    return run


def total_counts(parts, length: int, chunks: int, count: Callable | None = None) -> np.ndarray:
    """The sum of count tables (a DataFrame of chunk, counts): first per task, then per chunk.

    With `count` the tables are what it makes of the rows of parts, in the worker that sums them.
    """
    width, schema = length // chunks, "chunk int, counts binary"
    summed = parts.mapInArrow(tidy(add_counts(width, count)), schema).repartition(chunks, "chunk")
    out = np.zeros(length, np.uint32)
    for row in summed.mapInArrow(add_counts(width), schema).collect():  # one row per chunk
        raw = pa.decompress(bytes(row["counts"]), width * 4, "zstd")
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(raw, np.uint32)
    return out


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))) by Newton steps on the weighted log loss."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - label), weight * p * (1 - p) + 1e-12
        grad = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        mixed = (h * margin).sum()
        step = np.linalg.solve([[(h * margin**2).sum() + 1e-3, mixed], [mixed, h.sum() + 1e-3]], grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some ranges one after the other, and the range that each is from."""
    many = ends - starts
    owner = np.repeat(np.arange(len(starts)), many)
    shift = np.concatenate([[0], np.cumsum(many)])[:-1]
    return np.arange(many.sum()) - np.repeat(shift - starts, many), owner
