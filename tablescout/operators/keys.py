"""Distinct counts, duplicate rows and primary-key candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import sqltext
from tablescout.operators.columns import (
    chunks,
    col,
    column_names,
    flat_fields,
    is_present,
    missing_to_null,
    stack_rows,
    union_all,
    value_counts,
)
from tablescout.options import DEFAULTS, Options



def table_cardinality(
    df: DataFrame, method: str = "exact", options: Options = DEFAULTS
) -> DataFrame:
    """(column_no, column_name, total_rows, null_count, distinct_count) of one table.

    ``exact`` counts the groups of one long-form aggregation. ``approximate`` keeps one
    sketch per column instead (relative standard deviation 2 %) and shuffles nothing
    but the sketches.
    """
    fields = flat_fields(df)
    names = ["column_no", "column_name", "total_rows", "null_count", "distinct_count"]
    if method == "exact":
        counted = value_counts(df).groupBy("column_no").agg(
            F.sum("n").alias("total_rows"),
            F.sum(F.when(~is_present(), F.col("n"))).alias("null_count"),
            F.count_if(is_present()).alias("distinct_count"),
        )
        # from the schema, so that an empty table keeps its columns
        zero = F.lit(0).cast("bigint")
        return (
            column_names(df)
            .join(counted, "column_no", "left")
            .select(*names[:2], *[F.coalesce(F.col(c), zero).alias(c) for c in names[2:]])
        )
    if method != "approximate":
        raise ValueError(f"unknown method: {method}")
    parts = []
    for group in chunks(fields, options.aggregates_per_job // 2):
        quoted = [(no, f, sqltext.name(f.name)) for no, f in group]
        sketched = missing_to_null(df).selectExpr(
            "count(1) as total_rows",
            *[f"count({q}) as present_{no}" for no, _, q in quoted],
            *[f"approx_count_distinct({q}, 0.02D) as distinct_{no}" for no, _, q in quoted],
        )
        rows = [
            (no, sqltext.text(f.name), "total_rows", f"total_rows - present_{no}", f"distinct_{no}")
            for no, f, _ in quoted
        ]
        parts.append(stack_rows(sketched, rows, names))
    return union_all(parts)


def cardinality(catalog: dict[str, DataFrame], method: str = "exact") -> DataFrame:
    return union_all(
        [
            table_cardinality(df, method).select(
                F.lit(name).alias("table_name"), "column_name", "distinct_count"
            )
            for name, df in catalog.items()
            if flat_fields(df)
        ],
        "table_name string, column_name string, distinct_count bigint",
    )


def table_duplicates(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row, NULLs counting as equal.

    Maps are equal when their entries are, in any order; variants when their JSON is.

    Copies of a row collapse in the map-side aggregation before anything is shuffled.
    """
    keys = []
    for n, f in enumerate(df.schema.fields):
        key = col(f.name)
        if isinstance(f.dataType, T.MapType):
            key = F.array_sort(F.map_entries(key))
        elif isinstance(f.dataType, T.VariantType):
            key = F.to_json(key)
        keys.append(key.alias(f"k{n}"))
    return (
        missing_to_null(df)
        .select(*keys)
        .groupBy(*[f"k{n}" for n in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def duplicate_rows(catalog: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            table_duplicates(df).select(F.lit(name).alias("table_name"), "duplicate_rows")
            for name, df in catalog.items()
            if flat_fields(df)
        ],
        "table_name string, duplicate_rows bigint",
    )


def key_candidates(catalog: dict[str, DataFrame]) -> DataFrame:
    """Distinct count, duplicate rows of the table and key verdict per column."""
    counted = union_all(
        [
            table_cardinality(df).withColumn("table_name", F.lit(name))
            for name, df in catalog.items()
            if flat_fields(df)
        ]
    )
    is_key = (
        (F.col("null_count") == 0)
        & (F.col("distinct_count") == F.col("total_rows"))
        & (F.col("total_rows") > 0)
    )
    # both sides have at most one row per column of the catalog
    return counted.join(duplicate_rows(catalog), "table_name").select(
        "table_name",
        "column_name",
        "distinct_count",
        "duplicate_rows",
        F.when(is_key, "YES").otherwise("").alias("primary_key_candidate"),
    )
