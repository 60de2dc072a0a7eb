"""Repeated windows: every text without the stretches that also start anywhere else.

Suffixes are sorted by a radix sort that goes no deeper than `length` bytes, most significant
digits first, and drops a suffix as soon as its bucket holds no other. Equal groups at full
depth are exactly the repeated windows. The passes:

1. The first digit of the suffix at s is the smallest `digit`-byte string inside its window
   [s, s + length), by hash, with its distance from s. Neighbouring suffixes share theirs, so
   one row, an anchor with its run of suffixes, stands for about 70 of them. Buckets of one
   anchor end here.
2. The next digits are the rest of all windows of the run, taken at once. A bucket of two or
   more holds repeated windows only and needs no further pass.
3. In buckets of pass 1 that pass 2 has split, the windows that are left are compared (by
   128-bit hashes) with those of the other parts of the bucket, one text for each part.

Scale: an anchor travels as some 40 bytes, for about 70 bytes of text; buckets are counted with
partial sums, so a passage of any weight is no hot key. Bytes travel in pass 3 only, for the
edges of repeats. Buckets with more than `bucket` different contexts get one more pass first, by
blocks of 16 windows: the bytes that a block's windows share are the digit, the rest as in
pass 2. What is still in such a bucket is compared through a counted shuffle of windows instead
of in one task. Texts are known by 96 bits of their MD5: copies of a text share their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, kept, small_batches, text_of
from tablescout.llm.kernel import flat, mix, ranges, row_slices

LENGTH = 200
DIGIT = 32
BUCKET = 1_024
PIECE = 1 << 19
BLOCK = 16
SENT_BYTES = 64 << 20

ANCHORS = "key binary, place bigint, digit bigint, rest bigint"
CONTEXTS = "digit bigint, lone boolean, key binary, place bigint, context binary"
SPANS = "key binary, a bigint, b bigint"


class Hasher:
    """Hashes of all windows of some bytes from running sums of powers (modulo 2^64)."""

    def __init__(self, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(2**40, 2**60)) * 8 + 5
        inverse = pow(base, -1, 2**64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(most + 1, np.uint64(base))) * np.uint64(inverse)
            self.back = np.cumprod(np.full(most + 1, np.uint64(inverse))) * np.uint64(base)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))


HASHERS: dict[int, Hasher] = {}


def hasher(which: int, most: int = 0) -> Hasher:
    """One of two fixed hashers, for at least so many bytes; made once per process."""
    have = HASHERS.get(which)
    if have is None or len(have.power) <= most:
        have = HASHERS[which] = Hasher(1_000_003 + which, max(most, 2 * PIECE))
    return have


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbouring values, from running minima of blocks."""
    n = len(values)
    fill = np.full((-n) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, digit: int):
    """(text, anchor, first and last window of its run, two hashes) of every run of windows."""
    one, two = hasher(0, len(data)), hasher(1, len(data))
    starts = np.arange(len(data) - length + 1)
    sums = one.sums(data)
    places = np.arange(len(data) - digit + 1)
    hashes = one.windows(sums, places, places + digit)
    # upper bits of the hash, then the place: of equal ones the first counts
    low = np.uint64((1 << 24) - 1)
    at = least_in_windows((hashes & ~low) | places.astype(np.uint64), length - digit + 1) & low
    at = at.astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(starts)]
    inside = starts + length <= offsets[1:][text]
    same = (at[1:] == at[:-1]) & inside[1:] & inside[:-1] & (text[1:] == text[:-1])
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~same
    closes[:-1] &= ~same
    first, last = starts[opens], starts[closes]
    at = at[first]
    # the whole context, and where the run lies around its anchor
    whole = two.windows(two.sums(data), first, last + length)
    with np.errstate(over="ignore"):
        whole = mix(whole ^ ((at - first) * 1024 + (at - last)).astype(np.uint64))
    return text[first], at, first, last, hashes[at], whole


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, shift, bytes, offsets): some rows, or a stretch of one long text."""
    data, offsets = flat(column)
    for low, high in row_slices(offsets, PIECE):
        begin, end = int(offsets[low]), int(offsets[high])
        if end - begin <= PIECE or high - low > 1:
            yield low, 0, data[begin:end], offsets[low : high + 1] - begin
            continue
        for at in range(begin, end - length + 1, PIECE):
            stop = min(at + PIECE + length - 1, end)
            yield low, at - begin, data[at:stop], np.array([0, stop - at])


def _read_anchors(length: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, shift, data, offsets in _pieces(batch.column(1), length):
                if len(data) < length:
                    continue
                text, at, first, last, one, two = anchors(data, offsets, length, digit)
                from_start = at - offsets[:-1][text] + shift
                place = (from_start << 16) | ((at - first) << 8) | (at - last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + text)),
                        pa.array(place),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                    ],
                    ["key", "place", "digit", "rest"],
                )

    return run


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start."""
    at = place >> 16
    return at, at - ((place >> 8) & 255), at - (place & 255)


def _read_contexts(length: int):
    """The bytes of wanted runs: rows (key, text, wanted list of place, digit, lone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            place, digit, lone = lists.flatten().flatten()
            _, first, last = unpacked(place.to_numpy())
            begin = offsets[:-1][owner] + first
            size = last - first + length
            for low, high in row_slices(np.concatenate([[0], np.cumsum(size)]), PIECE):
                at, _ = ranges(begin[low:high], begin[low:high] + size[low:high])
                ends = np.concatenate([[0], np.cumsum(size[low:high])]).astype(np.int32)
                context = pa.BinaryArray.from_buffers(
                    pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(data[at])]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        digit.slice(low, high - low),
                        lone.slice(low, high - low),
                        batch.column(0).take(pa.array(owner[low:high])),
                        place.slice(low, high - low),
                        context,
                    ],
                    ["digit", "lone", "key", "place", "context"],
                )

    return run


def _windows(batch: pa.RecordBatch, length: int):
    """(row, window start in the text, two hashes) of all windows of some contexts."""
    digit, place = batch.column(0).to_numpy(), batch.column(3).to_numpy()
    at, first, last = unpacked(place)
    data, offsets = flat_bytes(batch.column(4))
    begin, row = ranges(offsets[:-1], offsets[:-1] + last - first + 1)
    start = first[row] + begin - offsets[:-1][row]
    out = []
    for which in (0, 1):
        h = hasher(which, len(data))
        with np.errstate(over="ignore"):
            salt = mix(digit.view(np.uint64)[row] + (at[row] - start).astype(np.uint64))
            out.append(mix(h.windows(h.sums(data), begin, begin + length) ^ salt))
    return row, start, *out


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _classes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A class number for every pair of hashes."""
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][number] == two).all():
        return number
    return np.unique(np.stack([one, two]), axis=1, return_inverse=True)[1].ravel()


def _spans(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows (sorted by row and start) as the stretches that they cover."""
    joined = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
    opens = np.concatenate([[True], ~joined])[: len(row)]
    closes = np.concatenate([~joined, [True]])[: len(row)]
    return pa.RecordBatch.from_arrays(
        [batch.column(2).take(pa.array(row[opens])), pa.array(start[opens]), pa.array(start[closes] + length)],
        ["key", "a", "b"],
    )


def _compare(length: int):
    """Repeated windows of whole buckets; rows come sorted by digit."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        row, start, one, two = _windows(batch, length)
        lone = batch.column(1).to_numpy(zero_copy_only=False)
        number = _classes(one, two)
        weight = np.bincount(number, weights=np.where(lone[row], 1, 2))
        found = (weight[number] >= 2) & lone[row]
        return _spans(batch, row[found], start[found], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                digits = batch.column(0).to_numpy()
                if held and held[-1].column(0)[-1].as_py() != digits[0] and size >= PIECE:
                    yield settle(held)
                    held, size = [], 0
                # up to the first bucket that begins beyond the bound
                ends = np.concatenate([np.flatnonzero(digits[1:] != digits[:-1]) + 1, [len(digits)]])
                bytes_to = flat_bytes(batch.column(4))[1][ends]
                cut = int(ends[min(int(np.searchsorted(bytes_to, PIECE - size)), len(ends) - 1)])
                held.append(batch.slice(0, cut))
                size += int(bytes_to[ends == cut][0])
                batch = batch.slice(cut)
        if held:
            yield settle(held)

    return run


def _read_windows(length: int):
    """A row for every window: two hashes, whether its context is single, its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                row, start, one, two = _windows(part, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        part.column(1).take(pa.array(row)),
                        part.column(2).take(pa.array(row)),
                        pa.array(start),
                    ],
                    ["one", "two", "lone", "key", "start"],
                )

    return run


def _read_blocks(length: int):
    """Contexts cut into blocks of neighbouring windows, as rows like those of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                digit, place = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                at, first, last = unpacked(place)
                data, offsets = flat_bytes(batch.column(4))
                block, row = ranges((at - last) // BLOCK, (at - first) // BLOCK + 1)
                # distances of the block's windows from the anchor
                far = np.minimum((at - first)[row], block * BLOCK + BLOCK - 1)
                close = np.maximum((at - last)[row], block * BLOCK)
                zero = offsets[:-1][row] + (at - first)[row]
                one, two = hasher(0, len(data)), hasher(1, len(data))
                shared = one.windows(one.sums(data), zero - block * BLOCK, zero - block * BLOCK - BLOCK + 1 + length)
                rest = two.windows(two.sums(data), zero - far, zero - close + length)
                with np.errstate(over="ignore"):
                    shared = mix(shared ^ mix(digit.view(np.uint64)[row] + block.astype(np.uint64)))
                    rest = mix(rest ^ (far * 1024 + close).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(pa.array(row)),
                        pa.array((at[row] << 16) | (far << 8) | close),
                        pa.array(shared.view(np.int64)),
                        pa.array(rest.view(np.int64)),
                        batch.column(1).take(pa.array(row)),
                    ],
                    ["key", "place", "digit", "rest", "lone"],
                )

    return run


def _buckets(rows: DataFrame, weight) -> tuple[DataFrame, DataFrame]:
    """The parts of all buckets, and those of buckets that are split and not settled."""
    parts = rows.groupBy("digit", "rest").agg(F.sum(weight).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    parts = kept(parts.select("digit", (F.col("n") == 1).alias("lone"), "at.key", "at.place"), "buckets")
    split = parts.groupBy("digit").agg(F.count(F.lit(1)).alias("size"), F.bool_or("lone").alias("open"))
    split = kept(split.filter("open and size > 1").select("digit", "size"), "split")
    return parts, kept(parts.join(split, "digit"), "left")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches as one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > reach[:-1]])[: len(starts)]
    closes = np.concatenate([opens[1:], [True]])[: len(starts)]
    return starts[opens], reach[closes]


def _merge(length: int):
    """Every text's stretches: runs (b = -1) and blocks (-3) without unsettled ones (-2, -4), and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            a, b = (x.to_numpy() for x in lists.flatten().flatten())
            packed = []
            for i in range(len(lists)):
                x, y = a[ends[i] : ends[i + 1]], b[ends[i] : ends[i + 1]]
                runs = [np.setdiff1d(x[y == all_of], x[y == all_of - 1]) for all_of in (-1, -3)]
                _, first, last = unpacked(np.concatenate(runs))
                span = y >= 0
                s, e = merged(np.concatenate([first, x[span]]), np.concatenate([last + length, y[span]]))
                packed.append(np.stack([s, e], 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "spans"])

    return run


def _cut():
    """Rows (row, text, spans) with size, spans as a list and the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            found, kept_bytes = [], []
            for i, packed in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                spans = np.frombuffer(packed.as_py() or b"", np.int64).reshape(-1, 2)
                edges = [0, *spans.ravel().tolist(), len(text)]
                kept_bytes.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                found.append([{"first": a, "last": b} for a, b in spans.tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(kept_bytes, pa.binary()),
                ],
                ["row", "n_bytes", "spans", "kept"],
            )

    return run


def _beside(texts: DataFrame, lists: DataFrame, size: int, how: str) -> DataFrame:
    """Texts with what is known of them, which is sent to all tasks where it is small."""
    return texts.join(F.broadcast(lists) if size <= SENT_BYTES else lists, "key", how)


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of some anchors' runs; a list is shorter than the text that it belongs to."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("place", "digit", "lone")).alias("wanted"))
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    lists = kept(lists.join(copies, "key", "left"), "wanted")
    size = lists.agg(F.sum(32 * F.size("wanted") + 64)).first()[0] or 0
    once = _beside(texts, lists.filter("copies is null"), size, "inner")
    # of copies one is read; a task sends each text at most once
    some = _beside(texts, lists.filter("copies > 1"), size, "inner").dropDuplicates(["key"])
    columns = ["key", "text", "wanted"]
    return once.select(columns).unionByName(some.select(columns)).mapInArrow(_read_contexts(length), CONTEXTS)


def repeated_spans(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, digit: int = DIGIT, bucket: int = BUCKET
) -> DataFrame:
    """(key, spans) of every text with repeats: 96 bits of its MD5 and packed (first, last + 1)
    byte places, of all windows of `length` bytes that start anywhere else too.

    `length` is 64 to 255. Null texts are empty; texts below `length` bytes have no windows.
    """
    if not 64 <= length <= 255 or not 8 <= digit <= length // 2:
        raise ValueError("length is 64 to 255, digit 8 to half of it")
    small_batches(docs.sparkSession)
    texts = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    texts = texts.filter(F.octet_length("text") >= length)
    read = texts.mapInArrow(_read_anchors(length, digit), ANCHORS)
    # pass 1: buckets of two and more
    often = read.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit")
    alive = kept(read.join(kept(often, "often"), "digit", "left_semi"), "anchors")
    # pass 2: runs whose whole context is there again
    parts, left = _buckets(alive, F.lit(1))
    # rows, and what b says of them, see _merge
    states = [(alive, -1), (parts.filter("lone"), -2)]
    # pass 3: split buckets, one context for each part; large ones block by block first
    contexts = [_contexts(texts, left.filter(F.col("size") <= bucket), length)]
    large = left.filter(F.col("size") > bucket)
    spans = []
    if not large.isEmpty():
        blocks = kept(_contexts(texts, large, length).mapInArrow(_read_blocks(length), f"{ANCHORS}, lone boolean"), "blocks")
        parts, left = _buckets(blocks, F.when(F.col("lone"), 1).otherwise(2))
        states += [(blocks.filter("lone"), -3), (parts.filter("lone"), -4)]
        contexts.append(_contexts(texts, left.filter(F.col("size") <= bucket), length))
        large = left.filter(F.col("size") > bucket)
        windows = kept(_contexts(texts, large, length).mapInArrow(
            _read_windows(length), "one bigint, two bigint, lone boolean, key binary, start bigint"
        ), "windows")
        weight = F.sum(F.when(F.col("lone"), 1).otherwise(2))
        twice = kept(windows.groupBy("one", "two").agg(weight.alias("n")).filter("n > 1").select("one", "two"), "twice")
        found = windows.filter("lone").join(twice, ["one", "two"], "left_semi")
        spans.append(found.select("key", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    for near in contexts:
        spans.append(near.repartition("digit").sortWithinPartitions("digit").mapInArrow(_compare(length), SPANS))
    for rows, state in states:
        spans.append(rows.select("key", F.col("place").alias("a"), F.lit(state).cast("long").alias("b")))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    lists = every.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    return lists.mapInArrow(_merge(length), "key binary, spans binary").filter("octet_length(spans) > 0")


def text_key(text_col: str):
    return F.substring(F.unhex(F.md5(text_of(text_col))), 1, 12)


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, digit: int = DIGIT, bucket: int = BUCKET
) -> DataFrame:
    """(row, n_bytes, spans, kept) of every row of docs.

    `row` is the input row as one struct, so that its names meet no others; `spans` are the
    maximal removed stretches, first and last + 1 byte, ascending; `kept` the bytes that are left,
    joined, which need not be whole characters. Null and empty texts have no bytes and no spans.
    Repeated rows are copies of each other: from `length` bytes on, nothing of them is left. An
    empty table gives no rows.
    """
    check_columns(docs, [text_col])
    spans = kept(repeated_spans(docs, text_col, length, digit, bucket), "spans")
    size = spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0
    packed = docs.select(
        text_key(text_col).alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_of(text_col).alias("text"),
    )
    joined = _beside(packed, spans, size, "left").select("row", "text", "spans")
    row = packed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _cut(), f"row {row}, n_bytes bigint, spans array<struct<first: bigint, last: bigint>>, kept binary"
    )


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """What remove_repeats does to every document, as counts and a digest of the kept bytes."""
    check_columns(docs, [id_col, text_col])
    cut = remove_repeats(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), length=length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return cut.select(
        F.col("row.id").alias(id_col),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
