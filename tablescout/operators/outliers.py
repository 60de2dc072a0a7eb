"""Quartiles, the interquartile outlier report and the outlying rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions import sqltext
from tablescout.functions.text import display_number
from tablescout.operators.columns import (
    as_double,
    chunks,
    col,
    missing_to_null,
    numeric_fields,
    stack_rows,
    union_all,
    with_order,
)
from tablescout.operators.quantiles import catalog_quantiles, column_quantiles
from tablescout.options import DEFAULTS, Options

MIN_VALUES = 4
FENCE = 1.5
SHOWN = 3

REPORT = (
    "table_name string, column_name string, range_low double, range_high double, "
    "outlier_count bigint, outlier_percent double"
)

Quartiles = dict[int, tuple[int, float | None, float | None]]


def catalog_quartiles(
    catalog: dict[str, DataFrame], options: Options = DEFAULTS, method: str = "exact"
) -> dict[str, Quartiles]:
    """{table: {column number: (n, q1, q3)}} of all numeric columns."""
    found = catalog_quantiles(
        {t: (df, numeric_fields(df)) for t, df in catalog.items()}, [0.25, 0.75], options, method
    )
    return {
        t: {no: (n, q1, q3) for no, (n, (q1, q3)) in columns.items()} for t, columns in found.items()
    }


def _fences(q1: float, q3: float) -> tuple[float, float]:
    reach = FENCE * (q3 - q1)
    return q1 - reach, q3 + reach


def _beyond(name: str, q1: float, q3: float) -> str:
    """SQL text that is true for values outside the fences."""
    low, high = _fences(q1, q3)
    value = as_double(name)
    return f"({value} < {sqltext.double(low)} or {value} > {sqltext.double(high)})"


def quartiles(
    catalog: dict[str, DataFrame], options: Options = DEFAULTS, method: str = "exact"
) -> DataFrame:
    """(table_name, column_name, n, q1, q3); columns without a value have NULLs."""
    spark = next(iter(catalog.values())).sparkSession
    found = catalog_quartiles(catalog, options, method)
    rows = [
        (t, f.name, *found[t][no]) for t, df in catalog.items() for no, f in numeric_fields(df)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, n bigint, q1 double, q3 double"
    )


def outlier_report(
    catalog: dict[str, DataFrame], options: Options = DEFAULTS, method: str = "exact"
) -> DataFrame:
    """Fences, number and percent of the values beyond them, from four values on.

    A first job finds the quartiles, a second scan counts. An interquartile range of 0
    is not special: every differing value then counts.
    """
    found = catalog_quartiles(catalog, options, method)
    names = [part.split()[0] for part in REPORT.split(", ")]
    parts = []
    for table, df in catalog.items():
        usable = [
            (no, f.name, *found[table][no])
            for no, f in numeric_fields(df)
            if found[table][no][0] >= MIN_VALUES
        ]
        for group in chunks(usable, options.aggregates_per_job):
            counted = missing_to_null(df).selectExpr(
                *[f"count_if({_beyond(c, q1, q3)}) as o_{no}" for no, c, _, q1, q3 in group]
            )
            rows = []
            for no, c, n, q1, q3 in group:
                low, high = _fences(q1, q3)
                rows.append(
                    (
                        sqltext.text(table),
                        sqltext.text(c),
                        f"round({sqltext.double(low)}, 2)",
                        f"round({sqltext.double(high)}, 2)",
                        f"o_{no}",
                        f"round(double(o_{no}) / {sqltext.double(n)} * double('100'), 2)",
                    )
                )
            parts.append(stack_rows(counted, rows, names))
    if not parts:
        return next(iter(catalog.values())).sparkSession.createDataFrame([], REPORT)
    return union_all(parts)


def outlier_rows(df: DataFrame, column: str, options: Options = DEFAULTS) -> DataFrame:
    """The rows whose value of one column lies beyond the fences."""
    fields = [(no, f) for no, f in numeric_fields(df) if f.name == column]
    if not fields:
        raise ValueError(f"no numeric column named {column}")
    n, (q1, q3) = column_quantiles(df, fields, [0.25, 0.75], options)[fields[0][0]]
    if n < MIN_VALUES:
        return df.where(F.lit(False))
    return missing_to_null(df).where(_beyond(column, q1, q3))


def table_outlier_examples(
    df: DataFrame, order_by: list[str] | None, quartiles_of: Quartiles
) -> DataFrame:
    """(column_no, column_name, outliers): count and first three outliers as text.

    ``N/A`` below four values, ``None`` for an interquartile range of 0 or no outlier.
    """
    verdicts = []
    searched = []
    for no, f in numeric_fields(df):
        n, q1, q3 = quartiles_of[no]
        verdicts.append((no, f.name, "N/A" if n < MIN_VALUES else "None"))
        if n >= MIN_VALUES and q1 != q3:
            searched.append((no, f.name, q1, q3))
    base = df.sparkSession.createDataFrame(
        verdicts, "column_no int, column_name string, otherwise string"
    )
    if not searched:
        return base.withColumnRenamed("otherwise", "outliers")

    keyed, keys = with_order(missing_to_null(df), order_by)
    ordered = keyed.select(*[col(c) for _, c, _, _ in searched], *keys)
    # counts in one pass; only the first three rows per column go through a sort
    counted = stack_rows(
        ordered.selectExpr(*[f"count_if({_beyond(c, q1, q3)}) as o_{no}" for no, c, q1, q3 in searched]),
        [(no, f"o_{no}") for no, *_ in searched],
        ["column_no", "count"],
    )
    cells = ", ".join(
        f"case when {_beyond(c, q1, q3)} then struct({no} as column_no, {as_double(c)} as value) end"
        for no, c, q1, q3 in searched
    )
    first = Window.partitionBy("column_no").orderBy(*keys, "value")
    examples = (
        ordered.selectExpr(*keys, f"explode(array_compact(array({cells}))) as cell")
        .selectExpr(*keys, "cell.column_no", "cell.value")
        .withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= SHOWN)
        .groupBy("column_no")
        .agg(F.array_sort(F.collect_list(F.struct("rn", F.round("value", 2).alias("value")))).alias("shown"))
    )
    sample = F.array_join(F.transform("shown", lambda e: display_number(e["value"])), ", ")
    found = F.concat(F.col("count").cast("string"), F.lit(" found (e.g. "), sample, F.lit(")"))
    return (
        base.join(counted, "column_no", "left")
        .join(examples, "column_no", "left")
        .select(
            "column_no",
            "column_name",
            F.when(F.col("count") > 0, found).otherwise(F.col("otherwise")).alias("outliers"),
        )
    )


def outlier_examples(
    catalog: dict[str, DataFrame],
    order_by: dict[str, list[str] | None],
    options: Options = DEFAULTS,
) -> DataFrame:
    found = catalog_quartiles(catalog, options)
    return union_all(
        [
            table_outlier_examples(df, order_by[name], found[name]).select(
                F.lit(name).alias("table_name"), "column_name", "outliers"
            )
            for name, df in catalog.items()
            if numeric_fields(df)
        ],
        "table_name string, column_name string, outliers string",
    )
