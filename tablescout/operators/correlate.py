"""Pairwise Pearson correlation of the numeric columns of a table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import sqltext
from tablescout.operators.columns import (
    Fields,
    as_double,
    chunks,
    missing_to_null,
    numeric_fields,
    stack_rows,
    union_all,
)
from tablescout.options import DEFAULTS, Options

# columns of one side of a block, and cells of the rows that a task looks at together
BLOCK = 512
CELLS = 1 << 20
MOMENTS = (
    "i int, j int, n double, sx double, sy double, xy double, xx double, yy double, "
    "x_low double, x_high double, y_low double, y_high double"
)

REPORT = "table_name string, column_1 string, column_2 string, correlation double"


def _facts(tables: dict[str, tuple[DataFrame, Fields]], options: Options) -> dict[tuple[str, int], tuple]:
    """{(table, column): (mean, has gaps, has two different values)}, from one job."""
    keys = list(tables)
    parts = []
    for key, t in enumerate(keys):
        df, fields = tables[t]
        for group in chunks(fields, options.aggregates_per_job // 4):
            measured = df.selectExpr(
                "count(1) as total",
                *[f"count({as_double(f.name)}) as n_{no}" for no, f in group],
                *[f"avg({as_double(f.name)}) as mean_{no}" for no, f in group],
                *[
                    f"min({as_double(f.name)}) <> max({as_double(f.name)}) as varies_{no}"
                    for no, f in group
                ],
            )
            rows = [(key, no, f"mean_{no}", f"n_{no} < total", f"varies_{no}") for no, f in group]
            parts.append(stack_rows(measured, rows, ["key", "column_no", "mean", "gaps", "varies"]))
    return {
        (keys[row["key"]], row["column_no"]): (row["mean"] or 0.0, row["gaps"], bool(row["varies"]))
        for row in union_all(parts).collect()
    }


def _gap_sums(i: int, a: str, b: str) -> list[str]:
    """Sums over the rows that have both values."""
    x, y = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    return [
        f"count({a} + {b}) as n_{i}",
        f"sum({x}) as sx_{i}",
        f"sum({y}) as sy_{i}",
        f"sum({a} * {b}) as xy_{i}",
        f"sum({x} * {x}) as xx_{i}",
        f"sum({y} * {y}) as yy_{i}",
        f"min({x}) <> max({x}) and min({y}) <> max({y}) as varies_{i}",
    ]


def _gap_correlation(i: int) -> str:
    def spread(s: str, ss: str) -> str:
        return f"sqrt(greatest({ss}_{i} - try_divide({s}_{i} * {s}_{i}, n_{i}), 0d))"

    together = f"(xy_{i} - try_divide(sx_{i} * sy_{i}, n_{i}))"
    spreads = f"({spread('sx', 'xx')} * {spread('sy', 'yy')})"
    return f"case when varies_{i} then try_divide({together}, {spreads}) end"


def _co_moments(width: int):
    """Of every task one row per pair of columns: counts, sums, products and extremes.

    They cover the rows that have both values. What a task holds is a fixed number of
    matrices of width x width, however many rows it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xy, xx = (np.zeros((width, width)) for _ in range(4))
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        step = max(CELLS // width, 1)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                there = known.astype(np.float64)
                n += there.T @ there
                s += x.T @ there
                xy += x.T @ x
                xx += (x * x).T @ there
                # [i, j]: extremes of i where j has a value
                least, most = np.where(known, x, np.inf), np.where(known, x, -np.inf)
                whole = known.all(axis=0)
                low[:, whole] = np.minimum(low[:, whole], least.min(axis=0)[:, None])
                high[:, whole] = np.maximum(high[:, whole], most.max(axis=0)[:, None])
                for j in np.flatnonzero(~whole & known.any(axis=0)):
                    low[:, j] = np.minimum(low[:, j], least[known[:, j]].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], most[known[:, j]].max(axis=0))
        i, j = np.triu_indices(width, 1)
        both = n[i, j] > 0
        i, j = i[both], j[both]
        columns = [n[i, j], s[i, j], s[j, i], xy[i, j], xx[i, j], xx[j, i], low[i, j], high[i, j], low[j, i], high[j, i]]
        names = [c.strip().split()[0] for c in MOMENTS.split(",")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, columns)], names
        )

    return run


def _matrix_rows(table: str, shifted: DataFrame, fields: Fields) -> list[DataFrame]:
    """The report rows of a wide table from mergeable co-moment matrices: one scan.

    Beyond 2 * BLOCK columns, one scan for each two blocks of columns.
    """
    blocks = [fields] if len(fields) <= 2 * BLOCK else chunks(fields, BLOCK)
    scans = [(blocks[0], [])] if len(blocks) == 1 else list(combinations(blocks, 2))
    seen: set[int] = set()
    parts = []
    for first, second in scans:
        taken = [*first, *second]
        # pairs inside a block come from the first scan that holds the block
        inside = [F.lit(True)]
        for block, at in ((first, 0), (second, len(first))):
            if block and block[0][0] in seen:
                inside.append(~(F.col("i").between(at, at + len(block) - 1) & F.col("j").between(at, at + len(block) - 1)))
            elif block:
                seen.add(block[0][0])
        wanted = inside[0]
        for condition in inside[1:]:
            wanted = wanted & condition
        moments = shifted.select(*[f"x{no}" for no, _ in taken]).mapInArrow(_co_moments(len(taken)), MOMENTS)
        sums = ["n", "sx", "sy", "xy", "xx", "yy"]
        merged = moments.where(wanted).groupBy("i", "j").agg(
            *[F.sum(c).alias(f"{c}_0") for c in sums],
            (
                (F.min("x_low") != F.max("x_high")) & (F.min("y_low") != F.max("y_high"))
            ).alias("varies_0"),
        )
        # pairs without a common row reach no task's rows
        names = shifted.sparkSession.createDataFrame(
            [(at, f.name) for at, (_, f) in enumerate(taken)], "at int, name string"
        )
        later = F.sequence(F.col("at") + 1, F.lit(len(taken) - 1))
        one = names.where(F.col("at") < len(taken) - 1).select(
            F.col("at").alias("i"), F.col("name").alias("column_1"), F.explode(later).alias("j")
        )
        two = names.select(F.col("at").alias("j"), F.col("name").alias("column_2"))
        pairs = one.join(two, "j").where(wanted)
        parts.append(
            pairs.join(merged, ["i", "j"], "left").select(
                F.lit(table).alias("table_name"),
                "column_1",
                "column_2",
                F.expr(f"round({_gap_correlation(0)}, 3) + 0d").alias("correlation"),
            )
        )
    return parts


def _pair_rows(
    table: str, df: DataFrame, fields: Fields, facts: dict[tuple[str, int], tuple], options: Options
) -> list[DataFrame]:
    """The report rows of one table, from one scan.

    The pairs of a narrow table fit one generated aggregate; those of a wider one are
    summed as matrices, so that no column is read once per group of pairs.
    """
    shifted = df.selectExpr(
        *[
            f"{as_double(f.name)} - {sqltext.double(facts[table, no][0])} as x{no}"
            for no, f in fields
        ]
    )
    pairs = list(combinations(fields, 2))
    if len(pairs) > options.aggregates_per_job // 7:
        return _matrix_rows(table, shifted, fields)
    sums: list[str] = ["count(1) as total"]
    squares = {}
    rows = []
    for i, ((no_a, a), (no_b, b)) in enumerate(pairs):
        _, gaps_a, varies_a = facts[table, no_a]
        _, gaps_b, varies_b = facts[table, no_b]
        if not (varies_a and varies_b):
            value = "cast(null as double)"
        elif gaps_a or gaps_b:
            sums += _gap_sums(i, f"x{no_a}", f"x{no_b}")
            value = _gap_correlation(i)
        else:
            sums.append(f"sum(x{no_a} * x{no_b}) as xy_{i}")
            squares |= {no: f"sum(x{no} * x{no}) as square_{no}" for no in (no_a, no_b)}
            value = f"try_divide(xy_{i}, sqrt(square_{no_a}) * sqrt(square_{no_b}))"
        # adding 0.0 turns a rounded -0.0 into 0.0
        rounded = f"round({value}, 3) + 0d"
        rows.append((sqltext.text(table), sqltext.text(a.name), sqltext.text(b.name), rounded))
    names = [part.split()[0] for part in REPORT.split(", ")]
    return [stack_rows(shifted.selectExpr(*sums, *squares.values()), rows, names)]


def correlation_report(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    """One row per pair of numeric columns; NULL where the correlation is undefined.

    A first job finds the means. The second sums products of the shifted values, which
    keeps the digits: one product per pair where both columns are complete, sums over
    the common rows otherwise. It reads a table once; see _pair_rows for wide tables.
    """
    tables = {}
    for name, df in catalog.items():
        fields = numeric_fields(df)
        if len(fields) > 1:
            tables[name] = (missing_to_null(df), fields)
    if not tables:
        return next(iter(catalog.values())).sparkSession.createDataFrame([], REPORT)
    facts = _facts(tables, options)
    return union_all(
        [part for name, (df, fields) in tables.items() for part in _pair_rows(name, df, fields, facts, options)]
    )
