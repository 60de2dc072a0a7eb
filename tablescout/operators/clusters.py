"""One-dimensional clusters of numeric columns, fitted on all rows.

Values are counted first and written once in order, with running counts and sums. A step of
the fit looks these up at the borders between clusters, so it costs the same for any number
of rows. Means of a step are rounded, scores too, so that neither the order of rows nor their
partitions show in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions import sqltext
from tablescout.operators.columns import (
    as_double,
    chunks,
    missing_to_null,
    numeric_fields,
    stack_rows,
    union_all,
)
from tablescout.operators.numbering import running_sums
from tablescout.options import DEFAULTS, Options
from tablescout.session import written

MIN_VALUES = 10
CENTRE_DECIMALS = 9
SCORE_DECIMALS = 9
# blocks of a column's index, and of all columns together
BLOCKS = 1 << 16
ALL_BLOCKS = 400_000

Fit = tuple[int, int]  # a column's position and a number of clusters


@dataclass(frozen=True)
class _Target:
    pos: int
    table_name: str
    name: str
    n: int


def _measure(
    tables: dict[str, list[tuple[int, str, list[str]]]],
    catalog: dict[str, DataFrame],
    names: list[str],
    options: Options,
) -> list[Row]:
    """(pos, *names) per column, one job; a column is (pos, name, aggregates as SQL text)."""
    parts = []
    for table, columns in tables.items():
        cleaned = missing_to_null(catalog[table])
        for group in chunks(columns, options.aggregates_per_job // len(names)):
            measured = cleaned.selectExpr(
                *[f"{a} as {n}_{pos}" for pos, _, wanted in group for n, a in zip(names, wanted)]
            )
            rows = [(pos, *[f"{n}_{pos}" for n in names]) for pos, _, _ in group]
            parts.append(stack_rows(measured, rows, ["pos", *names]))
    return union_all(parts).collect() if parts else []


def _targets(catalog: dict[str, DataFrame], options: Options) -> list[_Target]:
    """Numeric columns with at least ten values, three of them different."""
    columns = {
        pos: (table, f.name)
        for pos, (table, f) in enumerate(
            ((t, f) for t, df in catalog.items() for _, f in numeric_fields(df)), start=1
        )
    }
    by_table: dict[str, list[tuple[int, str, list[str]]]] = {}
    for pos, (table, name) in columns.items():
        c = as_double(name)
        wanted = [f"count({c})", f"min({c})", f"max({c})"]
        by_table.setdefault(table, []).append((pos, name, wanted))
    sizes = {}
    inner: dict[str, list[tuple[int, str, list[str]]]] = {}
    for row in _measure(by_table, catalog, ["n", "low", "high"], options):
        if row["n"] < MIN_VALUES or row["low"] == row["high"]:
            continue
        table, name = columns[row["pos"]]
        sizes[row["pos"]] = row["n"]
        # a third value exists when something lies strictly between the ends
        low, high = sqltext.double(row["low"]), sqltext.double(row["high"])
        c = as_double(name)
        wanted = [f"count_if({c} > {low} and {c} < {high})"]
        inner.setdefault(table, []).append((row["pos"], name, wanted))
    usable = {r["pos"] for r in _measure(inner, catalog, ["between"], options) if r["between"]}
    return [_Target(pos, *columns[pos], sizes[pos]) for pos in sorted(usable)]


def _histogram(catalog: dict[str, DataFrame], targets: list[_Target]) -> DataFrame:
    """(pos, v, n): value counts of every column."""
    parts = []
    for table, df in catalog.items():
        rows = [(t.pos, as_double(t.name)) for t in targets if t.table_name == table]
        if rows:
            parts.append(stack_rows(missing_to_null(df), rows, ["pos", "v"]))
    counted = union_all(parts).where(F.col("v").isNotNull()).groupBy("pos", "v")
    return written(counted.agg(F.count(F.lit(1)).alias("n")), "counts")


@dataclass(frozen=True)
class _Directory:
    """The blocks of one column's index: first and last value, rows and sum up to its end."""

    first: np.ndarray
    last: np.ndarray
    n_upto: np.ndarray
    s_upto: np.ndarray
    rows: int
    per_block: int


@dataclass(frozen=True)
class _Index:
    """Running counts and sums of every column's values, written once, and its directories."""

    rows: DataFrame
    blocks: dict[int, _Directory]

    def values_at(self, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """Values at some (position, row number from 1)."""
        found = {}
        left = []
        for pos, row in sorted(wanted):
            own = self.blocks[pos]
            if own.per_block == 1:
                found[pos, row] = float(own.first[row - 1])
            else:
                left.append((pos, (row - 1) // own.per_block, row))
        if left:
            places = self.rows.sparkSession.createDataFrame(left, "pos int, block bigint, row_no bigint")
            for r in self.rows.join(F.broadcast(places), ["pos", "block", "row_no"]).collect():
                found[r["pos"], r["row_no"]] = r["v"]
        return found

    def upto(self, borders: set[tuple[int, float]]) -> dict[tuple[int, float], tuple[int, float]]:
        """(rows, sum) of the values up to some (position, border); blocks that a border cuts are
        read, all others are known."""
        found = {}
        cut = []
        for pos, border in sorted(borders):
            own = self.blocks[pos]
            at = int(np.searchsorted(own.first, border, side="right")) - 1
            if at < 0:
                found[pos, border] = (0, 0.0)
            elif own.last[at] <= border:
                found[pos, border] = (int(own.n_upto[at]), float(own.s_upto[at]))
            else:
                cut.append((pos, at, border))
        if cut:
            places = self.rows.sparkSession.createDataFrame(cut, "pos int, block bigint, border double")
            inside = self.rows.join(F.broadcast(places), ["pos", "block"]).where("v <= border")
            ends = inside.groupBy("pos", "border").agg(
                F.max("n_upto").alias("n"), F.max_by("s_upto", "v").alias("s")
            )
            found |= {(r["pos"], r["border"]): (r["n"], r["s"]) for r in ends.collect()}
        return found


def _index(histogram: DataFrame) -> _Index:
    """The histogram in value order with running counts and sums, in blocks of equal rows.

    A column has at most BLOCKS blocks, all columns together ALL_BLOCKS: their edges are what
    the driver holds. Columns with fewer values have a block for each.
    """
    # one row per column
    sizes = {r["pos"]: r["m"] for r in histogram.groupBy("pos").agg(F.count(F.lit(1)).alias("m")).collect()}
    most = max(1, min(BLOCKS, ALL_BLOCKS // max(len(sizes), 1)))
    per_block = {pos: -(-m // most) for pos, m in sizes.items()}
    spark = histogram.sparkSession
    steps = spark.createDataFrame(list(per_block.items()), "pos int, per_block bigint")
    sums = {"row_no": F.lit(1), "n_upto": F.col("n"), "s_upto": F.col("n") * F.col("v")}
    running = running_sums(histogram, ["pos"], "v", sums)
    rows = running.join(F.broadcast(steps), "pos").withColumn(
        "block", F.floor((F.col("row_no") - 1) / F.col("per_block"))
    )
    rows = written(rows.drop("per_block"), "index")
    edges = rows.groupBy("pos", "block").agg(
        F.min("v").alias("first"),
        F.max("v").alias("last"),
        F.max("n_upto").alias("n_upto"),
        F.max_by("s_upto", "v").alias("s_upto"),
    )
    table = edges.orderBy("pos", "block").toArrow()  # at most ALL_BLOCKS rows
    columns = {name: table[name].to_numpy() for name in ("pos", "first", "last", "n_upto", "s_upto")}
    blocks = {}
    for pos, m in sizes.items():
        own = slice(*np.searchsorted(columns["pos"], [pos, pos + 1]))
        blocks[pos] = _Directory(
            *(columns[c][own] for c in ("first", "last", "n_upto", "s_upto")), m, per_block[pos]
        )
    return _Index(rows, blocks)


def _first_centres(index: _Index, options: Options) -> dict[Fit, list[float]]:
    """Evenly spaced quantiles of a column's distinct values, for every k tried."""
    places: dict[Fit, list[tuple[int, float]]] = {}
    for pos, own in index.blocks.items():
        for k in range(2, min(options.max_clusters, int(own.n_upto[-1]) - 1) + 1):
            at = [(2 * j + 1) / (2 * k) * (own.rows - 1) for j in range(k)]
            places[pos, k] = [(int(x), x - int(x)) for x in at]
    wanted = {
        (pos, min(row + step, index.blocks[pos].rows))
        for (pos, _), rows in places.items()
        for row, _ in rows
        for step in (1, 2)
    }
    found = index.values_at(wanted)
    centres = {}
    for (pos, k), rows in places.items():
        last = index.blocks[pos].rows
        pairs = [(found[pos, row + 1], found[pos, min(row + 2, last)], part) for row, part in rows]
        centres[pos, k] = [round(low + part * (high - low), CENTRE_DECIMALS) for low, high, part in pairs]
    return centres


def _middles(centres: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]


def _ends(index: _Index, centres: dict[Fit, list[float]]) -> dict[Fit, list[tuple[int, float]]]:
    """(rows, sum) up to the upper border of every cluster; a value on a border is below it."""
    found = index.upto({(pos, b) for (pos, _), c in centres.items() for b in _middles(c)})
    ends = {}
    for (pos, k), c in centres.items():
        own = index.blocks[pos]
        ends[pos, k] = [found[pos, b] for b in _middles(c)] + [(int(own.n_upto[-1]), float(own.s_upto[-1]))]
    return ends


def _sizes(ends: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Rows and sum of every cluster."""
    before = [(0, 0.0), *ends[:-1]]
    return [(n - m, s - r) for (n, s), (m, r) in zip(ends, before, strict=True)]


def _fit(index: _Index, options: Options) -> dict[Fit, list[float]]:
    """Centres moved to the means of their values until they stay.

    A step looks up the rows and sums at the borders, whatever the number of rows. A number
    of clusters that leaves one of them without values is dropped.
    """
    centres = _first_centres(index, options)
    moving = dict(centres)
    seen: dict[Fit, set[tuple[float, ...]]] = {key: set() for key in centres}
    while moving:
        for key, ends in _ends(index, moving).items():
            sizes = _sizes(ends)
            new = [
                round(s / n, CENTRE_DECIMALS) if n else c for (n, s), c in zip(sizes, moving[key], strict=True)
            ]
            if new == moving[key] or tuple(new) in seen[key]:
                centres[key] = new
                if not all(n for n, _ in sizes):
                    del centres[key]
                del moving[key]
            else:
                seen[key].add(tuple(new))
                moving[key] = new
    return centres


def _score(x: Column, size: Column, own: Column, other: Column) -> Column:
    """The silhouette of a value from its distances; alone in its cluster it scores 0."""
    ratio = F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0))
    return F.when(size == 1, F.lit(0.0)).otherwise(ratio)


def _silhouettes(index: _Index, centres: dict[Fit, list[float]]) -> DataFrame:
    """(pos, k, silhouette) of some fits, from one scan of the index.

    The distances to the own cluster follow from the running sums inside it, and of the
    other clusters only the two neighbours can be nearest.
    """
    rows = []
    for (pos, k), ends in _ends(index, centres).items():
        sizes = _sizes(ends)
        if any(n for n, _ in sizes[1:]) and any(n for n, _ in sizes[:-1]):
            before = [(0, 0.0), *ends[:-1]]
            means = [s / n if n else None for n, s in sizes]
            clusters = [
                (n_0, s_0, n, mean, lower, upper)
                for (n_0, s_0), (n, _), mean, lower, upper in zip(
                    before, sizes, means, [None, *means[:-1]], [*means[1:], None], strict=True
                )
            ]
            rows.append((pos, k, _middles(centres[pos, k]), clusters))
    one = "struct<n_0: bigint, s_0: double, size: bigint, mean: double, lower: double, upper: double>"
    # a row per column and k
    fits = index.rows.sparkSession.createDataFrame(rows, f"pos int, k int, borders array<double>, clusters array<{one}>")
    placed = index.rows.join(F.broadcast(fits), "pos").select(
        "pos", "k", "v", "n", "n_upto", "s_upto",
        F.get("clusters", F.size(F.filter("borders", lambda b: b < F.col("v")))).alias("c"),
    )
    x, size = F.col("v") - F.col("c.mean"), F.col("c.size")
    n_upto = F.col("n_upto") - F.col("c.n_0")
    # small numbers keep their digits; the values of a cluster less their mean sum to 0
    s_upto = F.col("s_upto") - F.col("c.s_0") - n_upto * F.col("c.mean")
    own = (n_upto * x - s_upto - s_upto - (size - n_upto) * x) / F.greatest(size - 1, F.lit(1))
    other = F.least(F.abs(F.col("v") - F.col("c.lower")), F.abs(F.col("v") - F.col("c.upper")))
    return (
        placed.withColumn("score", _score(x, size, own, other))
        .groupBy("pos", "k")
        .agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("silhouette"))
    )


def silhouette_1d(values: DataFrame) -> DataFrame:
    """(pos, k, silhouette) of (pos, k, v, n, cluster), by Euclidean distance.

    Clusters on a line are intervals: the distances to the own cluster follow from
    prefix sums, and of the other clusters only the two neighbours can be nearest.
    A value alone in its cluster scores 0. Clusterings with one cluster are left out.
    """
    stats = values.groupBy("pos", "k", "cluster").agg(
        F.sum("n").alias("size"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean")
    )
    # at most max_clusters rows per group
    line = Window.partitionBy("pos", "k").orderBy("cluster")
    neighbours = (
        stats.withColumn("before", F.lag("mean").over(line))
        .withColumn("after", F.lead("mean").over(line))
        .withColumn("clusters", F.count(F.lit(1)).over(Window.partitionBy("pos", "k")))
        .where(F.col("clusters") > 1)
    )
    shifted = values.join(F.broadcast(neighbours), ["pos", "k", "cluster"]).withColumn(
        "x", F.col("v") - F.col("mean")  # small numbers keep their digits in the sums
    )
    sums = {"n_upto": F.col("n"), "s_upto": F.col("n") * F.col("x")}
    placed = running_sums(shifted, ["pos", "k", "cluster"], "x", sums)
    x, size = F.col("x"), F.col("size")
    # the shifted values of a cluster sum to 0
    to_lower = F.col("n_upto") * x - F.col("s_upto")
    to_upper = -F.col("s_upto") - (size - F.col("n_upto")) * x
    own = (to_lower + to_upper) / F.greatest(size - 1, F.lit(1))
    other = F.least(F.abs(F.col("v") - F.col("before")), F.abs(F.col("v") - F.col("after")))
    return (
        placed.withColumn("score", _score(x, size, own, other))
        .groupBy("pos", "k")
        .agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("silhouette"))
    )


def _names(catalog: dict[str, DataFrame], targets: list[_Target]) -> DataFrame:
    spark = next(iter(catalog.values())).sparkSession
    return spark.createDataFrame(
        [(t.pos, t.table_name, t.name) for t in targets],
        "pos int, table_name string, column_name string",
    )


def cluster_scores(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    """(table_name, column_name, k, silhouette) for every number of clusters tried."""
    targets = _targets(catalog, options)
    if not targets:
        return _empty(catalog, "table_name string, column_name string, k int, silhouette double")
    index = _index(_histogram(catalog, targets))
    scores = _silhouettes(index, _fit(index, options))
    return scores.join(F.broadcast(_names(catalog, targets)), "pos").select(
        "table_name", "column_name", "k", F.round("silhouette", 6).alias("silhouette")
    )


def _empty(catalog: dict[str, DataFrame], schema: str) -> DataFrame:
    return next(iter(catalog.values())).sparkSession.createDataFrame([], schema)


def _best_centres(index: _Index, options: Options) -> dict[int, tuple[int, list[float]]]:
    """k and centres of the best k per column, the smaller of equals."""
    centres = _fit(index, options)
    best: dict[int, tuple[float, int]] = {}
    for r in _silhouettes(index, centres).collect():  # a row per column and k
        score = (round(r["silhouette"], SCORE_DECIMALS), -r["k"])
        best[r["pos"]] = max(best.get(r["pos"], score), score)
    return {pos: (-k, centres[pos, -k]) for pos, (_, k) in best.items()}


def cluster_report(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    """Size and value range of every cluster, counted over all rows; id 0 is lowest."""
    names = [
        "table_name",
        "column_name",
        "clusters_chosen",
        "cluster_id",
        "cluster_size",
        "range_low",
        "range_high",
    ]
    targets = _targets(catalog, options)
    if not targets:
        return _empty(
            catalog,
            "table_name string, column_name string, clusters_chosen int, cluster_id int, "
            "cluster_size bigint, range_low double, range_high double",
        )
    fitted = _best_centres(_index(_histogram(catalog, targets)), options)
    parts = []
    for table, df in catalog.items():
        own = [t for t in targets if t.table_name == table and t.pos in fitted]
        for group in chunks(own, options.aggregates_per_job // (3 * options.max_clusters)):
            aggregates, rows = [], []
            for t in group:
                k, centres = fitted[t.pos]
                c = as_double(t.name)
                for cluster, inside in enumerate(_intervals(c, _middles(centres))):
                    tag = f"{t.pos}_{cluster}"
                    aggregates += [
                        f"count_if({inside}) as n_{tag}",
                        f"min({c}) filter (where {inside}) as low_{tag}",
                        f"max({c}) filter (where {inside}) as high_{tag}",
                    ]
                    rows.append(
                        (
                            sqltext.text(table),
                            sqltext.text(t.name),
                            k,
                            cluster,
                            f"n_{tag}",
                            f"round(low_{tag}, 2)",
                            f"round(high_{tag}, 2)",
                        )
                    )
            parts.append(stack_rows(missing_to_null(df).selectExpr(*aggregates), rows, names))
    return union_all(parts).where(F.col("cluster_size") > 0)


def _intervals(value: str, borders: list[float]) -> list[str]:
    """Membership tests of the intervals between the borders, lowest first."""
    tests = []
    for i in range(len(borders) + 1):
        test = [f"{value} is not null"]
        if i > 0:
            test.append(f"{value} > {sqltext.double(borders[i - 1])}")
        if i < len(borders):
            test.append(f"{value} <= {sqltext.double(borders[i])}")
        tests.append("(" + " and ".join(test) + ")")
    return tests
