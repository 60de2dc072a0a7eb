"""Exact quantiles with linear interpolation, for columns of any length.

Radix selection: the values of all columns of all tables are counted in spans, and the
spans that hold a wanted rank are counted again, finer, until they hold one value. The result
does not depend on how the rows are laid out.
"""

from __future__ import annotations

import math
from collections.abc import Hashable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import sqltext
from tablescout.operators.columns import (
    Fields,
    as_double,
    chunks,
    col,
    missing_to_null,
    stack_rows,
    union_all,
)
from tablescout.options import DEFAULTS, Options

ACCURACY = 10_000
# spans per unit of the natural logarithm, and the largest logarithm of a double, rounded up
PER_UNIT = 16
LARGEST = 1_000
# parts of a span in the next scan; spans of so few values are told apart by value
STEPS = 4_096
FEW = 4_096

Measured = tuple[int, list[float | None]]


@dataclass(frozen=True)
class _Span:
    """n values, the least and the most of them."""

    low: float
    high: float
    n: int


def _aggregated(df: DataFrame, key: int, fields: Fields, aggregate: str) -> DataFrame:
    """(key, column_no, n, q) of one group of columns; aggregate is SQL text around {}."""
    measured = df.selectExpr(
        *[f"count({sqltext.name(f.name)}) as n_{no}" for no, f in fields],
        *[f"{aggregate.format(as_double(f.name))} as q_{no}" for no, f in fields],
    )
    rows = [(key, no, f"n_{no}", f"q_{no}") for no, f in fields]
    return stack_rows(measured, rows, ["key", "column_no", "n", "q"])


def row_counts(tables: dict[Hashable, DataFrame]) -> dict[Hashable, int]:
    """Rows per table, from one job."""
    keys = list(tables)
    # one row per table
    counted = [
        tables[k].agg(F.count(F.lit(1)).alias("n")).selectExpr(f"{i} as key", "n")
        for i, k in enumerate(keys)
    ]
    return {keys[row["key"]]: row["n"] for row in union_all(counted).collect()}


def _counted(
    tables: dict[str, tuple[DataFrame, Fields]], places: dict[int, tuple[str, str]], spans: dict[int, list[_Span]]
) -> dict[int, list[_Span]]:
    """{position: spans}: the values of some columns, dealt into finer spans; one scan.

    A first scan deals by sign and logarithm, later ones cut a span into STEPS; a span of few
    values is dealt by value. Counts are added up in the map tasks.
    """
    parts = []
    for t, (df, _) in tables.items():
        rows = [(pos, as_double(name)) for pos, (of, name) in places.items() if of == t]
        if rows:
            parts.append(stack_rows(df, rows, ["pos", "value"]))
    rows = union_all(parts).where("value is not null")
    if spans:
        held = [(pos, s.low, s.high, s.n <= FEW) for pos, own in spans.items() for s in own]
        # at most two spans per column and probability; they do not overlap
        wanted = rows.sparkSession.createDataFrame(held, "pos int, low double, high double, few boolean")
        rows = rows.join(F.broadcast(wanted), "pos").where("value between low and high")
        key = F.expr(f"if(few, value, floor((value - low) / (high - low) * {STEPS}))")
    else:
        size = f"floor(greatest(least(ln(abs(value)), {LARGEST}), -{LARGEST}) * {PER_UNIT}) + {2 * LARGEST * PER_UNIT}"
        key = F.expr(f"if(value = 0, 0, signum(value) * ({size}))")
        rows = rows.withColumn("low", F.lit(0.0))
    counted = rows.groupBy("pos", "low", key.cast("double").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    found: dict[int, list[_Span]] = {}
    for r in counted.collect():  # per column at most the logarithms of all doubles, or STEPS or FEW per span
        found.setdefault(r["pos"], []).append(_Span(r["least"], r["most"], r["n"]))
    return {pos: sorted(own, key=lambda s: s.low) for pos, own in found.items()}


def _ranked(
    tables: dict[str, tuple[DataFrame, Fields]], probs: list[float]
) -> dict[str, dict[int, Measured]]:
    """Exact quantiles of all columns by radix selection.

    Every scan counts the values of all columns in spans and keeps those that hold a wanted
    rank, until these are single values: two or three scans, nothing is sorted or moved but
    counts.
    """
    columns = [(t, no, f) for t, (_, fields) in tables.items() for no, f in fields]
    places = {pos: (t, f.name) for pos, (t, _, f) in enumerate(columns)}
    sizes: dict[int, int] = {}
    # what is left to find: rank in the column -> the span that holds it, its first rank
    wanted: dict[int, dict[int, tuple[_Span, int]]] = {}
    values: dict[tuple[int, int], float] = {}
    spans: dict[int, list[_Span]] = {}
    while True:
        found = _counted(tables, {p: places[p] for p in (wanted or places)}, spans)
        if not spans:
            for pos, own in found.items():
                n = sizes[pos] = sum(s.n for s in own)
                whole = _Span(own[0].low, own[-1].high, n)
                ranks = {r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
                wanted[pos] = {r: (whole, 0) for r in ranks}
        left: dict[int, dict[int, tuple[_Span, int]]] = {}
        for pos, ranks in wanted.items():
            for rank, (held, first) in ranks.items():
                for s in found[pos]:
                    if s.low < held.low or s.high > held.high:
                        continue
                    if rank < first + s.n:
                        break
                    first += s.n
                if s.low == s.high:
                    values[pos, rank] = s.low
                else:
                    left.setdefault(pos, {})[rank] = (s, first)
        if not left:
            break
        wanted = left
        spans = {pos: list({s for s, _ in ranks.values()}) for pos, ranks in left.items()}
    result: dict[str, dict[int, Measured]] = {t: {} for t in tables}
    for pos, (t, no, _) in enumerate(columns):
        n, quantiles = sizes.get(pos, 0), []
        for p in probs:
            at = p * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            if not n:
                quantiles.append(None)
            elif low == high or values[pos, low] == values[pos, high]:
                quantiles.append(values[pos, low])
            else:
                quantiles.append((high - at) * values[pos, low] + (at - low) * values[pos, high])
        result[t][no] = (n, quantiles)
    return result


def catalog_quantiles(
    tables: dict[str, tuple[DataFrame, Fields]],
    probs: list[float],
    options: Options = DEFAULTS,
    method: str = "exact",
) -> dict[str, dict[int, Measured]]:
    """{table: {column number: (non-missing count, quantiles)}}; a few numbers per column.

    ``approximate`` returns the built-in sketch's values, within 1/10000 of the rank.
    """
    if method not in ("exact", "approximate"):
        raise ValueError(f"unknown method: {method}")
    found: dict[str, dict[int, Measured]] = {t: {} for t in tables}
    cleaned = {
        t: (missing_to_null(df.select(*[col(f.name) for _, f in fields])), fields)
        for t, (df, fields) in tables.items()
        if fields
    }
    if not cleaned:
        return found
    if method == "exact":
        return found | _ranked(cleaned, probs)
    points = f"array({', '.join(sqltext.double(p) for p in probs)})"
    aggregate = f"percentile_approx({{}}, {points}, {ACCURACY})"
    keys = list(cleaned)
    parts = [
        _aggregated(df, key, group, aggregate)
        for key, (df, fields) in enumerate(cleaned.values())
        for group in chunks(fields, options.aggregates_per_job // 2)
    ]
    for row in union_all(parts).collect():
        values = row["q"] if row["q"] is not None else [None] * len(probs)
        found[keys[row["key"]]][row["column_no"]] = (row["n"], list(values))
    return found


def column_quantiles(
    df: DataFrame,
    fields: Fields,
    probs: list[float],
    options: Options = DEFAULTS,
    method: str = "exact",
) -> dict[int, Measured]:
    """Quantiles of some columns of one table."""
    return catalog_quantiles({"table": (df, fields)}, probs, options, method)["table"]
