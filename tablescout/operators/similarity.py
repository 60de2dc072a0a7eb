"""Relationship discovery: how alike are the columns of different tables.

Columns are compared by all their distinct values. `value_sample` alone samples: it shows
the distinct values with the smallest hash of every column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions import sqltext
from tablescout.functions.text import match_text, name_similarity, value_shape
from tablescout.operators.columns import (
    chunks,
    col,
    flat_fields,
    missing_to_null,
    stack_rows,
    union_all,
)
from tablescout.operators.quantiles import row_counts
from tablescout.options import DEFAULTS, Options
from tablescout.session import written

HASH_DIGITS = 16
SPARE = 4  # the thinned sample aims at this many times the wanted size


@dataclass(frozen=True)
class _CatalogColumn:
    pos: int
    table_no: int
    table_name: str
    column_name: str
    type_name: str


def _catalog_columns(catalog: dict[str, DataFrame]) -> list[_CatalogColumn]:
    found: list[_CatalogColumn] = []
    for table_no, (name, df) in enumerate(catalog.items(), start=1):
        for _, f in flat_fields(df):
            found.append(
                _CatalogColumn(len(found) + 1, table_no, name, f.name, f.dataType.simpleString())
            )
    return found


def columns_frame(catalog: dict[str, DataFrame]) -> DataFrame:
    """(pos, table_no, table_name, column_name): the schema of the catalog as rows."""
    spark = next(iter(catalog.values())).sparkSession
    rows = [(c.pos, c.table_no, c.table_name, c.column_name) for c in _catalog_columns(catalog)]
    return spark.createDataFrame(
        rows, "pos int, table_no int, table_name string, column_name string"
    )


def _hash_limit(distinct: int, wanted: int) -> str | None:
    """Hash prefix below which about SPARE times the wanted values lie."""
    share = SPARE * wanted / max(distinct, 1)
    if share >= 1:
        return None
    return format(int(share * 16**HASH_DIGITS), f"0{HASH_DIGITS}x")


def _hash_limits(
    df: DataFrame, columns: list[_CatalogColumn], wanted: int, options: Options
) -> dict[int, str]:
    """Limits for the columns of a large table, from distinct-count sketches."""
    limits = {}
    for group in chunks(columns, options.aggregates_per_job):
        row = df.selectExpr(
            *[f"approx_count_distinct({sqltext.name(c.column_name)}) as d_{c.pos}" for c in group]
        ).first()
        for c in group:
            limit = _hash_limit(row[f"d_{c.pos}"], wanted)
            if limit is not None:
                limits[c.pos] = limit
    return limits


def _match_values(df: DataFrame, columns: list[_CatalogColumn], limits: dict[int, str]) -> DataFrame:
    """(pos, value), one row per non-missing cell that passes its hash limit."""
    texts = missing_to_null(df).select(
        *[match_text(col(c.column_name), c.type_name).alias(f"c{c.pos}") for c in columns]
    )
    rows = []
    for c in columns:
        value = f"c{c.pos}"
        if c.pos in limits:
            value = f"case when left(md5(c{c.pos}), {HASH_DIGITS}) < '{limits[c.pos]}' then c{c.pos} end"
        rows.append((c.pos, value))
    return stack_rows(texts, rows, ["pos", "value"]).where("value is not null")


def _smallest_by_hash(values: DataFrame, wanted: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("hash", "value"))
    return (
        values.distinct()
        .withColumn("hash", F.md5("value"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= wanted)
        .select("pos", "value")
    )


def _columns_by_table(catalog: dict[str, DataFrame]) -> dict[str, list[_CatalogColumn]]:
    by_table: dict[str, list[_CatalogColumn]] = {}
    for c in _catalog_columns(catalog):
        by_table.setdefault(c.table_name, []).append(c)
    return by_table


def column_values(catalog: dict[str, DataFrame]) -> DataFrame:
    """(pos, value): the distinct values of every column."""
    cells = [_match_values(catalog[t], cs, {}) for t, cs in _columns_by_table(catalog).items()]
    return written(union_all(cells).distinct(), "values")


def _sampled_values(catalog: dict[str, DataFrame], options: Options) -> DataFrame:
    """(pos, value): of every column the distinct values with the smallest hash.

    On a large table only values below a hash limit are shuffled. The limit is an
    estimate, so the samples are counted and columns that came out short are drawn
    again without it; the result is the same either way.
    """
    by_table = _columns_by_table(catalog)
    wanted = options.similarity_sample
    limits: dict[int, str] = {}
    rows_of = row_counts({t: catalog[t] for t in by_table})
    for table, columns in by_table.items():
        if rows_of[table] > options.sample_prefilter_rows:
            limits |= _hash_limits(catalog[table], columns, wanted, options)
    cells = [_match_values(catalog[t], cs, limits) for t, cs in by_table.items()]
    sample = written(_smallest_by_hash(union_all(cells), wanted), "sample")
    if not limits:
        return sample
    limited = sample.where(F.col("pos").isin(*limits))
    sizes = {r["pos"]: r["count"] for r in limited.groupBy("pos").count().collect()}
    short = {pos for pos in limits if sizes.get(pos, 0) < wanted}
    if not short:
        return sample
    again = [
        _match_values(catalog[t], [c for c in cs if c.pos in short], {})
        for t, cs in by_table.items()
        if any(c.pos in short for c in cs)
    ]
    redrawn = written(_smallest_by_hash(union_all(again), wanted), "sample")
    return sample.where(~F.col("pos").isin(*short)).unionByName(redrawn)


def _with_names(values: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    # one row per column of the catalog on the right
    return values.join(F.broadcast(columns_frame(catalog)), "pos")


def value_sample(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    return _with_names(_sampled_values(catalog, options), catalog).select(
        "table_name", "column_name", "value"
    )


def _shapes(values: DataFrame, mode: str = "two_pass") -> DataFrame:
    return values.select("pos", value_shape(F.col("value"), mode).alias("value")).distinct()


def value_patterns(catalog: dict[str, DataFrame], mode: str = "two_pass") -> DataFrame:
    """(table_name, column_name, shape): the distinct value shapes of every column."""
    return _with_names(_shapes(column_values(catalog), mode), catalog).select(
        "table_name", "column_name", F.col("value").alias("shape")
    )


def _pairs(columns: DataFrame, how_many: int) -> DataFrame:
    """All pairs of columns of different tables, the earlier column first.

    The partner positions are listed per column and joined by position.
    """
    left = columns.where(F.col("pos") < how_many).select(
        *[F.col(c).alias(f"{c}_1") for c in columns.columns],
        F.explode(F.sequence(F.col("pos") + 1, F.lit(how_many))).alias("pos_2"),
    )
    right = columns.select(*[F.col(c).alias(f"{c}_2") for c in columns.columns])
    return left.join(right, "pos_2").where(F.col("table_no_1") != F.col("table_no_2"))


def _sizes(values: DataFrame, name: str) -> DataFrame:
    return values.groupBy("pos").agg(F.count(F.lit(1)).alias(name))


def column_pairs(catalog: dict[str, DataFrame]) -> DataFrame:
    """Pairs of columns of different tables with the sizes of their value sets."""
    values = column_values(catalog)
    sized = columns_frame(catalog).join(_sizes(values, "n"), "pos", "left").fillna(0, ["n"])
    return _pairs(sized, len(_catalog_columns(catalog))).select(
        "table_name_1", "column_name_1", "table_name_2", "column_name_2", "n_1", "n_2"
    )


def _overlaps(values: DataFrame, columns: DataFrame, name: str) -> DataFrame:
    """(pos_1, pos_2, common): number of values shared by columns of different tables.

    Values that occur in the same set of columns are counted first; partners are
    written out once per distinct set, not once per value.
    """
    # a set has at most one member per column of the catalog
    sets = (
        values.join(F.broadcast(columns.select("pos", "table_no")), "pos")
        .groupBy("value")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "table_no"))).alias("members"))
        .where(F.size("members") > 1)
        .groupBy("members")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    first = sets.select("shared", "members", F.posexplode("members").alias("at", "one"))
    later = F.filter(
        F.slice("members", F.col("at") + 2, F.size("members")),
        lambda m: m["table_no"] != F.col("one.table_no"),
    )
    return (
        first.select("shared", F.col("one.pos").alias("pos_1"), F.explode(later).alias("two"))
        .groupBy("pos_1", F.col("two.pos").alias("pos_2"))
        .agg(F.sum("shared").alias(name))
    )


def value_overlap(catalog: dict[str, DataFrame]) -> DataFrame:
    """Column pairs that share at least one value, with the number of shared values."""
    columns = columns_frame(catalog)
    found = _overlaps(column_values(catalog), columns, "common")
    names = columns.select("pos", "table_name", "column_name")
    for side in ("1", "2"):
        renamed = names.toDF(f"pos_{side}", f"table_name_{side}", f"column_name_{side}")
        found = found.join(F.broadcast(renamed), f"pos_{side}")
    return found.select(
        "table_name_1", "column_name_1", "table_name_2", "column_name_2", "common"
    )


def _jaccard(common: Column, n_1: Column, n_2: Column) -> Column:
    """Percent of shared values; 0 where a side is empty or nothing is shared."""
    shared = F.coalesce(common, F.lit(0)).cast("double")
    both = n_1 + n_2 - F.coalesce(common, F.lit(0))
    return F.when((n_1 == 0) | (n_2 == 0), F.lit(0.0)).otherwise(shared / both * 100.0)


def _scored_pairs(catalog: dict[str, DataFrame], with_shapes: bool) -> DataFrame:
    columns = columns_frame(catalog)
    how_many = len(_catalog_columns(catalog))
    values = column_values(catalog)
    sized = columns.join(_sizes(values, "n_values"), "pos", "left")
    overlaps = [_overlaps(values, columns, "common_values")]
    if with_shapes:
        shapes = _shapes(values)
        sized = sized.join(_sizes(shapes, "n_shapes"), "pos", "left")
        overlaps.append(_overlaps(shapes, columns, "common_shapes"))
    pairs = _pairs(sized.fillna(0), how_many)
    for overlap in overlaps:
        pairs = pairs.join(overlap, ["pos_1", "pos_2"], "left")
    scored = pairs.withColumn(
        "value_percent", _jaccard(F.col("common_values"), F.col("n_values_1"), F.col("n_values_2"))
    )
    if with_shapes:
        scored = scored.withColumn(
            "pattern_percent",
            _jaccard(F.col("common_shapes"), F.col("n_shapes_1"), F.col("n_shapes_2")),
        )
    return scored


def jaccard(catalog: dict[str, DataFrame]) -> DataFrame:
    """Value similarity of every pair of columns of different tables."""
    return _scored_pairs(catalog, with_shapes=False).select(
        "table_name_1",
        "column_name_1",
        "table_name_2",
        "column_name_2",
        F.round("value_percent", 1).alias("value_percent"),
    )


def _verdict(match: Column, value_percent: Column) -> Column:
    return (
        F.when((match >= 70) & (value_percent >= 50), "possible key / FK match")
        .when(match >= 70, "same format/pattern, values differ - verify")
        .when(match >= 50, "worth reviewing")
        .otherwise("weak match")
    )


def column_similarity(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    """Pairs that are alike by name, values or value shapes, best match first."""
    scored = _scored_pairs(catalog, with_shapes=True)
    named = scored.withColumn(
        "name_percent", name_similarity(F.col("column_name_1"), F.col("column_name_2"))
    )
    best = F.greatest("value_percent", "pattern_percent")
    matched = named.withColumn(
        "match", options.name_weight * F.col("name_percent") + options.value_weight * best
    ).where(F.col("match") >= options.similarity_threshold)
    return (
        matched.select(
            F.col("table_name_1").alias("table_1"),
            F.col("column_name_1").alias("column_1"),
            F.col("table_name_2").alias("table_2"),
            F.col("column_name_2").alias("column_2"),
            F.round("name_percent", 1).alias("name_similarity"),
            F.round("value_percent", 1).alias("value_similarity"),
            F.round("pattern_percent", 1).alias("pattern_similarity"),
            F.round("match", 1).alias("match_percent"),
            _verdict(F.col("match"), F.col("value_percent")).alias("likely_relationship"),
        )
        .orderBy(F.desc("match_percent"), "table_1", "column_1", "table_2", "column_2")
    )
