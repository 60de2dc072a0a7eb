"""Exact Jaccard join of documents on word n-grams with a token-group matrix.

1. Every document becomes the set of its distinct n-gram hashes (64 bits). Documents with
   equal sets (by a 128-bit digest) are one class, which its smallest id represents.
2. Representatives are partitioned into groups of similar sets: of MARKS min-hashes of a set,
   each together with the magnitude of its size, the one counts that most sets have; so
   nearly all of many near copies meet under a few marks, whatever their edits. Sets of one
   mark are dealt to parts of about `group_tokens` tokens, however many they are.
3. Two sets with similarity t or more share a token among the first n - ceil(t n) + 1 of
   each in any common order. Groups store the union of their members' first tokens; token
   by token, groups that share one and fit by size become candidates. The order puts rare
   tokens first, by a table of counts over all documents (2^20 to 2^24 cells, one byte
   each, so the broadcast is bounded); a cell shared by two tokens changes the order, never
   the result.
4. For a candidate pair of groups each member of one is bounded by its overlap with the
   other's token union; only members whose bound reaches t open the group, as one row
   against a token matrix. Found links leave as a spanning forest of the pair and as the
   number of linked documents of each member: every link is counted, none is written out.
5. Links are joined to components by star contraction. Its nodes are classes, not ids, so
   two texts under one id stay two documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm import kernel
from tablescout.llm.common import broadcast_if_small, check_columns, kept, small_batches, text_of
from tablescout.llm.components import components

CHUNKS = 64  # the count table travels in so many parts
GROUP_TOKENS = 32_768
DOC_TOKENS = 128
PAIRS_AT_ONCE = 1 << 20
MARKS = 6
COLUMNS = 512
FULL = 255  # a count that may be larger; such a row is always opened

LINKS = ["u", "v", "links"]

LEAST = [f"least{i}" for i in range(MARKS)]
PROFILE = f"id long, n long, d1 long, d2 long, {', '.join(f'{x} long' for x in LEAST)}, chunk int, counts binary"


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent / 100 * n) in whole numbers."""
    return (n * percent + 99) // 100


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, sorted distinct n-gram hashes, offsets) of slices."""
    for low, high, data, offsets in kernel.texts(column):
        w = kernel.words_of(data, offsets)
        yield low, high, *kernel.distinct(*kernel.shingles(w, kernel.hash_words(w), size))


def _digests(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of every set, in two halves."""
    with np.errstate(over="ignore"):
        one = kernel.sums(kernel.mix(tokens + kernel.STEP), offsets)
        two = kernel.sums(kernel.mix(tokens * kernel.STEP + kernel.MIX1), offsets)
    return one.view(np.int64), two.view(np.int64)


def _min_hashes(tokens: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MARKS min-hashes of every set; tokens are hashes, so an odd factor orders them anew."""
    factors = kernel.mix(np.arange(1, MARKS + 1, dtype=np.uint64) * kernel.STEP) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [kernel.least(tokens * factor, offsets).view(np.int64) for factor in factors]


def _columns(tokens: np.ndarray) -> bytes:
    """How many tokens of a set fall into each column of the matrix."""
    at = (kernel.mix(tokens) & np.uint64(COLUMNS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=COLUMNS), FULL).astype(np.uint8).tobytes()


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _profiles(size: int, bits: int):
    """Of every document its set's size, digest and min-hash; of every task its token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in PROFILE.split(",")]
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for low, high, tokens, offsets in _sets(batch.column(1), size):
                one, two = _digests(tokens, offsets)
                least = _min_hashes(tokens, offsets)
                np.add.at(counts, _cells(tokens, bits), 1)
                rows = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, rows),
                        pa.array(np.diff(offsets)),
                        pa.array(one),
                        pa.array(two),
                        *map(pa.array, least),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names,
                )
        if counts.any():
            packed, none = kernel.pack_counts(counts, CHUNKS), pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * (4 + MARKS) + packed.columns, names)

    return run


def _classes(profiles: DataFrame, bits: int) -> np.ndarray:
    """One byte per cell: the order of magnitude of its count over all documents."""
    parts = profiles.filter("chunk is not null").select("chunk", "counts")
    counts = kernel.total_counts(parts, 1 << bits, CHUNKS)
    # half steps of the logarithm; 0 and 1 are alike
    return np.round(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _prefixes(size: int, bits: int, percent: int, shared):
    """(id, d1, first tokens in the common order, matrix row) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for low, high, tokens, offsets in _sets(batch.column(1), size):
                one, _ = _digests(tokens, offsets)
                kind = classes[_cells(tokens, bits)]
                parts, ends, rows = [], [0], []
                for i in range(high - low):
                    mine = tokens[offsets[i] : offsets[i + 1]]
                    first = len(mine) - _needed(len(mine), percent) + 1 if len(mine) else 0
                    # the tokens are sorted, so a stable sort by class is the common order
                    order = np.argsort(kind[offsets[i] : offsets[i + 1]], kind="stable")[:first]
                    parts.append(mine[order])
                    ends.append(ends[-1] + len(order))
                    rows.append(_columns(mine))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        pa.array(one),
                        kernel.lists(np.concatenate(parts), np.array(ends)),
                        pa.array(rows, pa.binary()),
                    ],
                    ["id", "d1", "tokens", "row"],
                )

    return run


def _candidates(percent: int):
    """Pairs of groups, or a group with itself, that share a first token and fit by size.

    Rows are (token, group, smallest size, largest size, documents).
    """

    def flush(pairs: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["g1", "g2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_batches = list(batches)  # the rows of one shuffle partition
        if not sum(b.num_rows for b in held_batches):
            return
        table = pa.Table.from_batches(held_batches)
        token, gid, low, high, docs = (table.column(i).to_numpy() for i in range(5))
        order = np.lexsort((low, token))
        token, gid, low, high = token[order], gid[order], low[order], high[order]
        own = gid[docs[order] > 1]
        pairs, held = [np.stack([own, own], axis=1)], len(own)
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        for k in np.flatnonzero(np.diff(edges) > 1):
            a, b = edges[k], edges[k + 1]
            for i in range(a, b - 1):  # groups by their smallest size: one window per group
                last = i + 1 + np.searchsorted(low[i + 1 : b], high[i] * 100 // percent, side="right")
                near = np.arange(i + 1, last)
                near = near[high[near] * 100 >= low[i] * percent]
                if len(near):
                    pairs.append(np.stack([np.minimum(gid[i], gid[near]), np.maximum(gid[i], gid[near])], axis=1))
                    held += len(near)
                if held >= PAIRS_AT_ONCE:
                    yield flush(pairs)
                    pairs, held = [], 0
        if held:
            yield flush(pairs)

    return run


def _may_link(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], percent: int, same: bool) -> bool:
    """Whether any two members of two groups may link, by sizes and matrix rows."""
    sizes, rows = two
    for i, (n, row) in enumerate(zip(*one, strict=True)):
        fits = (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent)
        if same:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        most = np.minimum(rows[at], row).sum(axis=1, dtype=np.int64)
        reach = 100 * most >= percent * (sizes[at] + n - most)
        if (reach | (rows[at] == FULL).any(axis=1)).any():
            return True
    return False


def _open(percent: int):
    """Of candidate pairs (g1, g2, members, members), those whose bound is reached."""

    def matrix(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        rows = members.values
        data = b"".join(rows.field("row").to_pylist())
        return rows.field("n").to_numpy(zero_copy_only=False), np.frombuffer(data, np.uint8).reshape(-1, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g1, g2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = [
                _may_link(matrix(batch.column(2)[i]), matrix(batch.column(3)[i]), percent, g1[i] == g2[i])
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["g1", "g2"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def _members(size: int):
    """(gid, node, documents, set) of the classes that take part in a candidate group.

    Rows are (id, text, d1, gid, node, documents).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, tokens, offsets in _sets(batch.column(1), size):
                one, _ = _digests(tokens, offsets)
                same = one == batch.column(2).to_numpy()[low:high]
                out = pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(at).slice(low, high - low) for at in (3, 4, 5)],
                        kernel.lists(tokens, offsets),
                    ],
                    ["gid", "node", "docs", "tokens"],
                )
                yield out.filter(pa.array(same))

    return run


class Forest:
    """Union-find over a few positions; says whether a link was new."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_between(
    one: list[np.ndarray], two: list[np.ndarray] | None, percent: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j that i links to) between two groups' sets, or within one, where two is None.

    Positions of the second group follow those of the first; within one group j > i.
    """
    inner = two is None
    target = one if inner else two
    sizes = np.array([len(x) for x in target])
    union, at = np.unique(np.concatenate(target), return_inverse=True)
    matrix = None
    shift = 0 if inner else len(one)
    for i, query in enumerate(one):
        place = np.searchsorted(union, query)
        place[place == len(union)] = 0
        place = place[union[place] == query]
        # what the query shares with the union bounds what it shares with any member
        if 100 * len(place) < percent * len(query):
            continue
        if matrix is None:
            matrix = np.zeros((len(target), len(union)), np.uint8)
            matrix[np.repeat(np.arange(len(target)), sizes), at] = 1
        common = matrix[:, place].sum(axis=1, dtype=np.int64)
        linked = 100 * common >= percent * (sizes + len(query) - common)
        if inner:
            linked[: i + 1] = False
        if linked.any():
            yield i, shift + np.flatnonzero(linked)


def _arrays(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, numbers of documents and sets of a group's list of (node, docs, tokens)."""
    rows = members.values
    tokens = rows.field("tokens")
    flat = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = tokens.offsets.to_numpy()
    nodes, docs = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "docs"))
    return nodes, docs, [flat[ends[i] : ends[i + 1]] for i in range(len(nodes))]


def _verify(percent: int):
    """Of opened pairs (g1, g2, members, members): spanning links (u, v, null) and, for every
    member u with links, (u, null, documents that it links to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, degrees = [], [], []
            for g1, g2, first, second in zip(*batch.columns, strict=True):
                nodes, docs, one = _arrays(first)
                two = None
                if g1 != g2:
                    more, counts, two = _arrays(second)
                    nodes, docs = np.concatenate([nodes, more]), np.concatenate([docs, counts])
                forest, linked = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
                for i, found in links_between(one, two, percent):
                    linked[i] += docs[found].sum()
                    linked[found] += docs[i]
                    for j in found.tolist():
                        if forest.join(i, j):
                            u.append(nodes[i])
                            v.append(nodes[j])
                has = np.flatnonzero(linked)
                degrees.append((nodes[has], linked[has]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64())], LINKS
            )
            if degrees:
                ends, counts = (np.concatenate(x) for x in zip(*degrees, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends, pa.int64()), pa.nulls(len(ends), pa.int64()), pa.array(counts, pa.int64())], LINKS
                )

    return run


def _with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(g1, g2, members of g1, members of g2)."""
    one = members.select(F.col("gid").alias("g1"), F.col("members").alias("one"))
    two = members.select(F.col("gid").alias("g2"), F.col("members").alias("two"))
    return pairs.join(one, "g1").join(two, "g2").select("g1", "g2", "one", "two")


def _marked(classes: DataFrame, percent: int) -> DataFrame:
    """Classes with the mark of their group: the most frequent of their min-hashes among sets of
    like size; where none is shared, one of their own."""
    magnitude = F.floor(F.log("n") / math.log(100 / min(percent, 99)))
    marks = F.array(*[F.xxhash64(F.lit(i), x, magnitude) for i, x in enumerate(LEAST)])
    each = classes.select("node", F.explode(marks).alias("mark"))
    shared = each.groupBy("mark").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    best = each.join(shared, "mark").groupBy("node").agg(F.max(F.struct("sets", "mark"))["mark"].alias("mark"))
    own = F.xxhash64(F.lit(MARKS), "d1", "d2")
    return classes.join(best, "node", "left").withColumn("mark", F.coalesce("mark", own)).drop(*LEAST)


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_links.

    Two documents link when 100 * shared n-grams >= percent * all their n-grams; the
    component is the smallest id reachable by links, n_links the number of other documents
    that a document links to, copies with equal sets among them. Texts are read whole, A-Z counts as
    a-z, words end at ASCII white space; fewer than `size` words form one n-gram. A text
    that is null or without words has an empty set, is its own component and has no links.
    Rows that repeat an id are documents of their own: they are joined by their texts, never
    by the id. A null id keeps its n_shingles, links with nothing and has null in the last
    two columns. Other columns are not read; an empty table gives no rows.
    """
    check_columns(docs, [id_col, text_col])
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    bits = min(24, max(20, math.ceil(math.log2(docs.count() + 1)) + 4))
    profiles = kept(rows.mapInArrow(kernel.tidy(_profiles(size, bits)), PROFILE), "ngram-profiles")
    shared = spark.sparkContext.broadcast(_classes(profiles, bits).tobytes())

    members = profiles.filter("chunk is null").select("id", "n", "d1", "d2", *LEAST)
    classes = (
        members.filter("n > 0 and id is not null")
        .groupBy("d1", "d2")
        .agg(
            F.min("id").alias("rep"),
            F.min("n").alias("n"),
            *[F.min(x).alias(x) for x in LEAST],
            F.count(F.lit(1)).alias("docs"),
        )
    )
    # the number of a class is written with it, so it stays the same
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    marked = kept(_marked(classes, percent), "ngram-marked")
    # a document weighs some tokens itself, which bounds the rows of a group's matrix;
    # only marks with more than one part are joined, at most total / group_tokens
    heavy = marked.groupBy("mark").agg(F.sum(F.col("n") + DOC_TOKENS).alias("tokens"))
    heavy = heavy.filter(F.col("tokens") > group_tokens)
    heavy = kept(heavy.withColumn("parts", F.ceil(F.col("tokens") / group_tokens)), "ngram-heavy")
    part = F.pmod(F.xxhash64("d1"), F.coalesce("parts", F.lit(1)))
    gid = F.xxhash64("mark", part).alias("gid")
    reps = marked.join(heavy, "mark", "left").select("rep", "n", "d1", "d2", "docs", "node", gid)
    reps = kept(reps, "ngram-reps")

    # groups that share a first token
    first = rows.filter("id is not null").mapInArrow(
        kernel.tidy(_prefixes(size, bits, percent, shared)), "id long, d1 long, tokens array<long>, row binary"
    )
    first = first.join(reps.select(F.col("rep").alias("id"), "d1", "gid", "n"), ["id", "d1"])
    first = kept(first, "ngram-first")
    unions = (
        first.select("gid", "n", F.explode("tokens").alias("token"))
        .groupBy("token", "gid")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("docs"))
    )
    pairs = unions.repartition("token").mapInArrow(kernel.tidy(_candidates(percent)), "g1 long, g2 long")
    pairs = kept(pairs.distinct(), "ngram-pairs")

    # the bound, on matrix rows
    repeated = members.groupBy("id", "d1").count().filter("count > 1 and id is not null").limit(1).count()
    taking_part = pairs.select(F.explode(F.array("g1", "g2")).alias("gid")).distinct()
    bounds = first.join(taking_part, "gid").select("gid", "id", "d1", "n", "row")
    if repeated:  # rows repeat with id and text
        bounds = bounds.dropDuplicates(["id", "d1"])
    bounds = bounds.groupBy("gid").agg(F.collect_list(F.struct("n", "row")).alias("members"))
    opened = _with_members(pairs, bounds).mapInArrow(kernel.tidy(_open(percent)), "g1 long, g2 long")
    opened = kept(opened, "ngram-opened")

    # the sets of the groups that are opened
    wanted = opened.select(F.explode(F.array("g1", "g2")).alias("gid")).distinct()
    chosen = kept(reps.join(wanted, "gid").select(F.col("rep").alias("id"), "d1", "gid", "node", "docs"), "ngram-chosen")
    texts = rows.join(broadcast_if_small(chosen, chosen.count()), "id")
    texts = texts.select("id", "text", "d1", "gid", "node", "docs")
    sets = texts.mapInArrow(kernel.tidy(_members(size)), "gid long, node long, docs long, tokens array<long>")
    if repeated:
        sets = sets.dropDuplicates(["node"])
    groups = sets.groupBy("gid").agg(F.collect_list(F.struct("node", "docs", "tokens")).alias("members"))
    found = _with_members(opened, groups).mapInArrow(kernel.tidy(_verify(percent)), "u long, v long, links long")
    found = kept(found, "ngram-links")
    joined = components(found.filter("v is not null").select("u", "v"))
    degrees = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))

    # only linked classes are joined: a component's smallest id, and the links of a class
    smallest = (
        joined.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    )
    linked = joined.join(smallest, "component").join(degrees, "node").select("node", "smallest", "links")
    labels = reps.join(linked, "node", "left").select(
        F.col("d1").alias("r1"),
        F.col("d2").alias("r2"),
        F.coalesce("smallest", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"),
    )
    same = (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")) & (F.col("n") > 0)
    known = F.col("id").isNotNull()
    return members.join(labels, same, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component", "id")).alias("component_id"),
        F.when(known, F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
