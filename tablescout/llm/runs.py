"""Periodic runs of words, found on a grammar of each text.

Re-Pair turns the word ids of a text into a grammar: a pair of neighbouring symbols that
occurs twice becomes a new symbol, the most frequent ones first, until no pair repeats. A run
has a lowest node of the derivation that contains it whole, and crosses the boundary between
that node's two halves. So runs are looked for at boundaries only: once for each nonterminal, at
one of its places, and carried over to all its places in the derivation; what is left of the text
at the top is halved down to single symbols. Of the stretches found the maximal ones stay.

At a boundary with n words around it only periods up to n / 3 count, and the four words beside
the boundary must come again one period further on; a candidate is extended both ways by
comparing hashes of stretches (sums of powers modulo two primes) in steps of falling length.

The work is numpy over a few MB of text at a time, whole texts side by side; a round of
Re-Pair replaces all pairs that are more frequent than the pairs they overlap. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, fold, small_batches, text_of, word_list
from tablescout.llm.kernel import hash_words, mix, ranges, texts, words_of

LEAST = 24
TIMES = 3
PRIMES = (2_147_483_647, 2_147_483_629)
# (node, period) pairs looked at together
TOGETHER = 1 << 21


class Equal:
    """Lengths of equal stretches of a sequence."""

    def __init__(self, values: np.ndarray):
        self.parts = []
        n = len(values)
        for prime, base in zip(PRIMES, (1_000_000_007, 998_244_353), strict=True):
            p = np.uint64(prime)
            power = np.ones(n + 1, np.uint64)
            have = 1
            while have <= n:  # doubling
                step = np.uint64(pow(base, have, prime))
                more = min(have, n + 1 - have)
                power[have : have + more] = power[:more] * step % p
                have += more
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values % p * power[:n] % p, out=sums[1:])
            self.parts.append((p, power, sums % p))

    def same(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether the stretches at x < y are equal."""
        out = np.ones(len(x), bool)
        for p, power, sums in self.parts:
            a = (sums[x + length] + p - sums[x]) % p * power[y - x] % p
            out &= a == (sums[y + length] + p - sums[y]) % p
        return out

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the sequence is equal from x < y on, or back from them."""
        got = np.zeros(len(x), np.int64)
        if not len(x):
            return got
        step = 1 << int(most.max()).bit_length()
        while step:
            at = np.flatnonzero(got + step <= most)
            if len(at):
                shift = -got[at] - step if back else got[at]
                good = at[self.same(x[at] + shift, y[at] + shift, step)]
                got[good] += step
            step >>= 1
        return got


def crossing(
    low: np.ndarray, middle: np.ndarray, high: np.ndarray, four: np.ndarray, equal: Equal, least: int, times: int
) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside [low, high) that hold words on both sides
    of middle, the smallest period of each stretch."""
    found = [(np.zeros(0, np.int64),) * 4]
    widest = (high - low) // times
    for right in (True, False):
        room = (high - middle if right else middle - low) - 4
        many = np.clip(np.minimum(widest, room), 0, None)
        ends = np.cumsum(many)
        begin = 0
        while begin < len(many):
            done = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + TOGETHER, side="right")))
            period, node = ranges(np.ones(stop - begin, np.int64), many[begin:stop] + 1)
            at = middle[begin:stop][node] - (0 if right else 4)
            hit = np.flatnonzero(four[at] == four[at + period if right else at - period])
            period, node = period[hit], node[hit] + begin
            x = middle[node] - (0 if right else period)
            ahead = equal.reach(x, x + period, high[node] - x - period)
            behind = equal.reach(x, x + period, x - low[node], back=True)
            start, end = x - behind, x + period + ahead
            good = end - start >= np.maximum(least, times * period)
            found.append((node[good], start[good], end[good], period[good]))
            begin = stop
    node, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return first_of(node, start, end, period)


def first_of(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows that are equal but for the last column, the one with the smallest there."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
    return tuple(c[new] for c in columns)


@dataclass
class Grammar:
    """Rules as nodes (low, middle, high) at one place each, their other places, and the texts'
    top symbols by their starts."""

    nodes: list[np.ndarray]
    places: list[np.ndarray]
    starts: np.ndarray
    text: np.ndarray


def repair(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, least: int) -> Grammar:
    """Re-Pair on all texts together; an id belongs to one text. Rules shorter than least are
    replaced but not kept."""
    symbol, start, new = ids.astype(np.int64), np.arange(len(ids)), int(ids.max(initial=-1)) + 1
    nodes, places, tops = [], [], []
    while len(symbol):
        pair = np.flatnonzero(text[1:] == text[:-1])
        keys, which = np.unique((symbol[pair] << 32) | symbol[pair + 1], return_inverse=True)
        # of overlapping equal pairs every second one counts
        again = np.zeros(len(pair), bool)
        again[1:] = (pair[1:] == pair[:-1] + 1) & (which[1:] == which[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(pair))))
        counts = ((np.arange(len(pair)) - head) & 1) == 0
        often = np.bincount(which[counts], minlength=len(keys))
        counts &= often[which] >= 2
        if not counts.any():
            break
        # the more frequent pair goes first, equally frequent ones in random order
        score = (often.astype(np.uint64) << np.uint64(32)) | (mix(keys.view(np.uint64)) >> np.uint64(32))
        rank = np.zeros(len(symbol) + 1, np.uint64)
        rank[pair[counts] + 1] = score[which[counts]]
        at = pair[counts]
        best = (rank[at + 1] > rank[at]) & (rank[np.minimum(at + 2, len(symbol))] <= rank[at + 1])
        at, rule = at[best], which[counts][best]
        chosen = np.bincount(rule, minlength=len(keys)) >= 2
        at, rule = at[chosen[rule]], rule[chosen[rule]]
        live = np.zeros(int(text[-1]) + 1, bool)
        live[text[pair[counts]]] = True
        follows = np.append(start[1:], 0)
        follows[np.append(text[1:] != text[:-1], True)] = ends[text[np.append(text[1:] != text[:-1], True)]]
        high = follows[at + 1]
        long = high - start[at] >= least
        if long.any():
            here, of = at[long], rule[long]
            order = np.argsort(of, kind="stable")
            here, of = here[order], of[order]
            opens = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            one = here[opens]
            nodes.append(np.stack([start[one], start[one + 1], follows[one + 1]]))
            places.append((np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(of)))), start[here]))
        number = np.cumsum(chosen) - 1
        symbol[at] = new + number[rule]
        new += int(chosen.sum())
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        # texts without a repeated pair are done
        ended = ~live[text]
        tops.append((start[ended], text[ended]))
        stays &= ~ended
        symbol, start, text = symbol[stays], start[stays], text[stays]
    tops.append((start, text))
    starts, text = (np.concatenate(x) for x in zip(*tops, strict=True))
    order = np.argsort(starts)
    return Grammar(nodes, places, starts[order], text[order])


def find_runs(
    hashes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs; first are the texts' borders in the words."""
    counts = np.diff(first)
    none = np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    wide = np.flatnonzero(counts[text] >= least)
    if not len(wide):
        return none, none, none, none
    # only texts that can hold a run, side by side
    hashes, text = hashes[wide], text[wide]
    shift = wide - np.arange(len(wide))
    ends = np.zeros(len(counts), np.int64)
    big = np.flatnonzero(counts >= least)
    ends[big] = np.cumsum(counts[big])
    with np.errstate(over="ignore"):
        own = mix(hashes + mix(text.astype(np.uint64) + np.uint64(1)))
        four = np.zeros(len(hashes), np.uint64)
        many = np.uint64(0x9E3779B97F4A7C15)
        part = hashes[:-3]
        for k in (1, 2, 3):
            part = part * many + hashes[k : len(hashes) - 3 + k]
        four[:-3] = mix(part)
    grammar = repair(np.unique(own, return_inverse=True)[1], text, ends, least)
    equal = Equal(hashes)
    found = []
    for (low, middle, high), (of, place) in zip(grammar.nodes, grammar.places, strict=True):
        node, start, end, period = crossing(low, middle, high, four, equal, least, times)
        # to all places of the nonterminal
        begins, stops = np.searchsorted(of, node), np.searchsorted(of, node, side="right")
        at, row = ranges(begins, stops)
        moved = place[at] - low[node][row]
        found.append((start[row] + moved, end[row] + moved, period[row]))
    # the texts' top symbols, halved
    starts, top = grammar.starts, grammar.text
    begin = np.searchsorted(top, np.arange(len(counts)))
    stop = np.searchsorted(top, np.arange(len(counts)), side="right")
    place = np.arange(len(top)) - begin[top]
    edge = np.append(starts, 0)
    half = 1
    while half < int((stop - begin).max()):
        at = np.flatnonzero(place % (2 * half) == half)
        after = at + half
        low = starts[at - half]
        high = np.where(after < stop[top[at]], edge[np.minimum(after, len(starts))], ends[top[at]])
        wide_node = high - low >= least
        found.append(crossing(low[wide_node], starts[at][wide_node], high[wide_node], four, equal, least, times)[1:])
        half *= 2
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none,) * 3
    of = text[start]
    # of stretches with one period inside each other the longest stays
    order = np.lexsort((-end, start, period, of))
    of, start, end, period = of[order], start[order], end[order], period[order]
    if len(of):
        group = np.cumsum(np.append(0, (of[1:] != of[:-1]) | (period[1:] != period[:-1])))
        far = np.maximum.accumulate(group * (len(hashes) + 1) + end)
        inside = np.append(False, far[:-1] >= (group * (len(hashes) + 1) + end)[1:])
        of, start, end, period = (x[~inside] for x in (of, start, end, period))
    of, start, end, period = first_of(of, start, end, period)
    moved = shift[start] - first[of]
    start, end = start + moved, end + moved
    order = np.lexsort((period, start, of))
    return of[order], start[order], end[order], period[order]


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray, many: int) -> pa.Array:
    """Words joined by one space, as one string for each text."""
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    size = length + ~last
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    if len(ends):
        out[ranges(ends - size, ends - size + length)[0]] = data[ranges(start, start + length)[0]]
    offsets = np.append(0, ends)[np.searchsorted(text, np.arange(many + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(many, pa.py_buffer(offsets), pa.py_buffer(out))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in texts(batch.column(1)):
                w = words_of(data, offsets, lower=False)
                of, start, end, period = find_runs(hash_words(w), w.first, least, times)
                gone = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(gone, w.first[of] + start + period, 1)
                np.add.at(gone, w.first[of] + end, -1)
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(high - low + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start), pa.array(end - start), pa.array(period)], fields=list(RUN)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(w.counts.astype(np.int64)),
                        runs,
                        _joined(w.data, w.start[stay], w.length[stay], w.doc[stay], high - low),
                    ],
                    ["row", "n_words", "runs", "collapsed"],
                )

    return run


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(row, n_words, runs, collapsed) of every row of docs.

    A run is a maximal stretch of at least `least` words that repeats its smallest period at
    least `times` times; `runs` are (start, length, period) by start, then period. `collapsed`
    has the words that no run holds after its first period, joined by one space. `row` is the
    input row as one struct, so that its names meet no others. Null, empty and blank texts have
    no words, no runs and an empty string. Every row is looked at by itself, repeated ones
    too; an empty table gives no rows. `least` is 24 or more, `times` 3 or more.
    """
    check_columns(docs, [text_col])
    if least < 24 or times < 3:
        raise ValueError("at least 24 words and 3 periods")
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, text_of(text_col).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        _collapse(least, times),
        f"row {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string",
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first of equal ones; null for none."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.get(runs, F.lit(0)),
        lambda a, b: F.when(better(b, a), b).otherwise(a),
    )


def planted_periods(id_col: str, text_col: str) -> Column:
    """The text; for ids whose crc32 ends in 0 its words repeat from some place on."""
    h = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = word_list(text_of(text_col))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    turned = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    turned = F.slice(F.concat(F.slice(words, F.lit(1), a), turned), F.lit(1), n)
    return F.when(fold(id_col, 10) == 0, F.array_join(turned, " ")).otherwise(text_of(text_col))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every document, with periods planted by planted_periods, as counts, the
    strongest run and digests. A null id counts as an empty one."""
    check_columns(docs, [id_col, text_col])
    packed = docs.select(F.col(f"`{id_col}`").alias("id"), planted_periods(id_col, text_col).alias("text"))
    found = collapse_runs(packed).withColumn("top", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("row.id").alias(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
