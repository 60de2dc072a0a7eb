"""Per-column descriptions: mode, mean, median, range, outliers and the first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions import sqltext
from tablescout.functions.text import display_number
from tablescout.operators.columns import (
    CELL,
    as_double,
    cell_order,
    cell_text,
    chunks,
    col,
    column_names,
    failing_columns,
    flat_fields,
    is_present,
    missing_to_null,
    numeric_fields,
    stack_rows,
    union_all,
    value_counts,
    with_order,
)
from tablescout.operators.outliers import Quartiles, table_outlier_examples
from tablescout.operators.quantiles import Measured, catalog_quantiles, row_counts
from tablescout.options import DEFAULTS, Options

SHOWN_MODES = 3


def table_modes(df: DataFrame) -> DataFrame:
    """(column_no, column_name, mode): the most frequent values, up to three of them.

    Ties are listed in the order of the typed value; more than three end in " ...".
    """
    fields = flat_fields(df)
    counted = value_counts(df).where(is_present())
    # one row per (column, frequency): far fewer rows than values
    frequency = counted.groupBy("column_no", "n").agg(F.count(F.lit(1)).alias("ties"))
    top = frequency.groupBy("column_no").agg(
        F.max_by(F.struct("n", "ties"), "n").alias("top")
    ).select("column_no", F.col("top.n").alias("n"), F.col("top.ties").alias("ties"))
    # one row per column on the right; the ties are cut to three before they move
    rank = F.row_number().over(Window.partitionBy("column_no").orderBy(*cell_order()))
    shown = (
        counted.join(F.broadcast(top.select("column_no", "n")), ["column_no", "n"])
        .select("column_no", *CELL)
        .withColumn("rank", rank)
        .where(F.col("rank") <= SHOWN_MODES)
        .select("column_no", "rank", cell_text(fields).alias("text"))
        .groupBy("column_no")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("shown"))
    )
    listed = F.array_join(F.transform("shown", lambda e: e["text"]), ", ")
    more = F.when(F.col("ties") > SHOWN_MODES, F.lit(" ...")).otherwise(F.lit(""))
    return (
        column_names(df)
        .join(top.join(shown, "column_no"), "column_no", "left")
        .select(
            "column_no",
            "column_name",
            F.coalesce(F.concat(listed, more), F.lit("N/A")).alias("mode"),
        )
    )


def column_mode(catalog: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            table_modes(df).select(F.lit(name).alias("table_name"), "column_name", "mode")
            for name, df in catalog.items()
            if flat_fields(df)
        ],
        "table_name string, column_name string, mode string",
    )


SUMMARY = ["column_no", "column_name", "mean", "median", "value_range"]


def _numeric_rows(
    df: DataFrame, medians: dict[int, Measured], options: Options
) -> list[DataFrame]:
    """SUMMARY rows of one table, one part per group of columns."""
    parts = []
    for group in chunks(numeric_fields(df), options.aggregates_per_job // 3):
        doubles = [(no, as_double(f.name)) for no, f in group]
        measured = missing_to_null(df).selectExpr(
            *[f"avg({c}) as mean_{no}" for no, c in doubles],
            *[f"max({c}) - min({c}) as range_{no}" for no, c in doubles],
        )
        rows = [
            (
                no,
                sqltext.text(f.name),
                f"round(mean_{no}, 3)",
                f"round({sqltext.double(medians[no][1][0])}, 3)",
                f"round(range_{no}, 3)",
            )
            for no, f in group
        ]
        parts.append(stack_rows(measured, rows, SUMMARY))
    return parts


def _medians(
    catalog: dict[str, DataFrame], options: Options, method: str = "exact"
) -> dict[str, dict[int, Measured]]:
    tables = {t: (df, numeric_fields(df)) for t, df in catalog.items()}
    return catalog_quantiles(tables, [0.5], options, method)


def numeric_summary(
    catalog: dict[str, DataFrame], options: Options = DEFAULTS, method: str = "exact"
) -> DataFrame:
    """(table_name, column_name, mean, median, value_range) of the numeric columns."""
    medians = _medians(catalog, options, method)
    return union_all(
        [
            part.select(F.lit(name).alias("table_name"), *SUMMARY[1:])
            for name, df in catalog.items()
            for part in _numeric_rows(df, medians[name], options)
        ],
        "table_name string, column_name string, mean double, median double, value_range double",
    )


def shown_cell(df: DataFrame, name: str) -> Column:
    """Preview text of one cell, empty for a missing value."""
    kind = dict(df.dtypes)[name]
    c = col(name)
    if kind in ("double", "float"):
        text = display_number(c.cast("double"))
    elif kind == "binary":
        text = F.make_valid_utf8(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def table_first_rows(df: DataFrame, order_by: list[str] | None, options: Options = DEFAULTS) -> DataFrame:
    """(column_no, column_name, row_1 ..): the first rows, one output row per column.

    The order is an argument; None takes the rows as they are read, which is the order
    of the lines for a table of one file. Only the few first rows leave the sort.
    """
    wanted = range(1, options.first_rows + 1)
    keyed, keys = with_order(missing_to_null(df), order_by)
    first = (
        keyed.select(*[col(f.name) for _, f in flat_fields(df)], *keys)
        .orderBy(*keys)
        .limit(options.first_rows)
    )
    # at most first_rows rows reach this window
    numbered = first.withColumn("row_no", F.row_number().over(Window.orderBy(*keys)))
    shown = [shown_cell(df, f.name).alias(f"c{no}") for no, f in flat_fields(df)]
    cells = stack_rows(
        numbered.select("row_no", *shown),
        [(no, "row_no", f"c{no}") for no, _ in flat_fields(df)],
        ["column_no", "row_no", "text"],
    )
    turned = cells.groupBy("column_no").agg(
        *[F.max(F.when(F.col("row_no") == i, F.col("text"))).alias(f"row_{i}") for i in wanted]
    )
    return (
        column_names(df)
        .join(turned, "column_no", "left")
        .select(
            "column_no",
            "column_name",
            *[F.coalesce(F.col(f"row_{i}"), F.lit("")).alias(f"row_{i}") for i in wanted],
        )
    )


def first_rows(
    catalog: dict[str, DataFrame], order_by: dict[str, list[str] | None], options: Options = DEFAULTS
) -> DataFrame:
    return union_all(
        [
            table_first_rows(df, order_by[name], options)
            .withColumn("table_name", F.lit(name))
            .drop("column_no")
            for name, df in catalog.items()
            if flat_fields(df)
        ],
        "table_name string, column_name string, "
        + ", ".join(f"row_{i} string" for i in range(1, options.first_rows + 1)),
    )


def _table_description(
    df: DataFrame,
    order_by: list[str] | None,
    quartiles_of: Quartiles,
    medians: dict[int, Measured],
    options: Options,
) -> DataFrame:
    """One row per column: type, first rows, mean, median, mode, range and outliers."""
    types = df.sparkSession.createDataFrame(
        [(no, f.dataType.simpleString()) for no, f in flat_fields(df)],
        "column_no int, data_type string",
    )
    parts = [types, table_first_rows(df, order_by, options), table_modes(df).drop("column_name")]
    texts = []
    if numeric_fields(df):
        numbers = union_all(_numeric_rows(df, medians, options))
        texts = [*SUMMARY[2:], "outliers"]
        parts.append(
            numbers.select("column_no", *[display_number(F.col(c)).alias(c) for c in SUMMARY[2:]])
        )
        parts.append(table_outlier_examples(df, order_by, quartiles_of).drop("column_name"))
    # every part has one row per column of the table
    joined = reduce(lambda a, b: a.join(b, "column_no", "left"), parts)
    previews = [f"row_{i}" for i in range(1, options.first_rows + 1)]
    not_available = [
        (F.coalesce(F.col(c), F.lit("N/A")) if c in texts else F.lit("N/A")).alias(c)
        for c in (*SUMMARY[2:], "outliers")
    ]
    return joined.select(
        "column_no", "column_name", "data_type", *previews, "mode", *not_available
    )


def _without_values(df: DataFrame, failing: dict[int, str]) -> DataFrame:
    """df with NULL in place of the columns that cannot be evaluated."""
    if not failing:
        return df
    return df.select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name) if no in failing else col(f.name)
            for no, f in enumerate(df.schema.fields, start=1)
        ]
    )


def _with_problems(description: DataFrame, failing: dict[int, str]) -> DataFrame:
    """The description with the problem of each failing column where its outliers are."""
    if not failing:
        return description
    cases = " ".join(f"when {no} then {sqltext.text(f'N/A ({why})')}" for no, why in failing.items())
    return description.withColumn("outliers", F.expr(f"case column_no {cases} else outliers end"))


def describe_tables(
    catalog: dict[str, DataFrame],
    order_by: dict[str, list[str] | None],
    options: Options = DEFAULTS,
) -> DataFrame:
    """Descriptions of all tables that have rows, with their shape.

    A column whose values cannot be evaluated (a failing cast or function in a view) does
    not end the report: it has its type, empty first rows, N/A and the error's condition.
    Where rows are ordered by such a column, their order is that of the other keys.
    """
    rows = row_counts(catalog)
    filled = {t: df for t, df in catalog.items() if rows[t] and flat_fields(df)}
    failing = {t: failing_columns(df) for t, df in filled.items()}
    filled = {t: _without_values(df, failing[t]) for t, df in filled.items()}
    # quartiles and medians come from the same run
    tables = {t: (df, numeric_fields(df)) for t, df in filled.items()}
    measured = catalog_quantiles(tables, [0.25, 0.5, 0.75], options) if filled else {}
    quartiles_of = {t: {no: (n, q[0], q[2]) for no, (n, q) in m.items()} for t, m in measured.items()}
    medians = {t: {no: (n, [q[1]]) for no, (n, q) in m.items()} for t, m in measured.items()}
    return union_all(
        [
            _with_problems(
                _table_description(df, order_by[t], quartiles_of[t], medians[t], options), failing[t]
            ).select(
                F.lit(t).alias("table_name"),
                F.lit(rows[t]).cast("bigint").alias("table_rows"),
                F.lit(len(df.columns)).alias("table_columns"),
                "*",
            )
            for t, df in filled.items()
        ],
        "table_name string, table_rows bigint, table_columns int, column_no int, column_name string, "
        "data_type string, "
        + "".join(f"row_{i} string, " for i in range(1, options.first_rows + 1))
        + "mode string, mean string, median string, value_range string, outliers string",
    )
