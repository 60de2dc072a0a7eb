"""Data dictionary: type label, missing, blank and unparseable counts per column."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import sqltext
from tablescout.functions.text import BLANK_TEXT, DATE_LAYOUTS, LONGEST_DATE, NUMBER_TEXT
from tablescout.operators.columns import (
    FLOAT_TYPES,
    INTEGER_TYPES,
    NESTED_TYPES,
    TIME_TYPES,
    chunks,
    missing_to_null,
    stack_rows,
    union_all,
)
from tablescout.options import DEFAULTS, Options
from tablescout.sources.catalog import FolderCatalog

NUMERIC_TEXT = "numeric (stored as text)"
DATE_TEXT = "date (stored as text)"
ALL_BLANK = "unknown (all blank)"

COUNTS = ["data_type", "total_rows", "null_count", "error_count", "blank_count"]


def _fixed_label(kind: T.DataType) -> str | None:
    """Label of a column whose type alone decides it."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, INTEGER_TYPES):
        return "integer"
    if isinstance(kind, FLOAT_TYPES + (T.DecimalType,)):
        return "decimal"
    if isinstance(kind, TIME_TYPES):
        return "date/time"
    if isinstance(kind, NESTED_TYPES):
        return "nested"
    return None


def _date_test(value: str, layout: str, shape: str) -> str:
    """The length rules out long texts without a regex, the shape most others without parsing."""
    parsed = f"try_to_timestamp({value}, {sqltext.text(layout)}) is not null"
    return (
        f"case when octet_length({value}) between 6 and {LONGEST_DATE} "
        f"and {value} rlike {sqltext.text(shape)} then {parsed} else false end"
    )


def _counts(no: int, field: T.StructField) -> list[str]:
    q = sqltext.name(field.name)
    counts = [f"count({q}) as present_{no}"]
    if _fixed_label(field.dataType) is None:
        value = f"string({q})"
        counts.append(f"count_if({value} rlike {sqltext.text(BLANK_TEXT)}) as blank_{no}")
        counts.append(f"count_if({value} rlike {sqltext.text(NUMBER_TEXT)}) as number_{no}")
        counts += [
            f"count_if({_date_test(value, layout, shape)}) as date{i}_{no}"
            for i, (layout, shape) in enumerate(DATE_LAYOUTS)
        ]
    return counts


def _row(no: int, field: T.StructField) -> list[str]:
    missing = f"total_rows - present_{no}"
    label = _fixed_label(field.dataType)
    head = [str(no), sqltext.text(field.name)]
    if label is not None:
        return [*head, sqltext.text(label), "total_rows", missing, "0L", "0L"]
    dates = f"greatest({', '.join(f'date{i}_{no}' for i in range(len(DATE_LAYOUTS)))})"
    # more than nine tenths, in whole numbers
    numeric = f"number_{no} * 10 > present_{no} * 9"
    dated = f"{dates} * 10 > present_{no} * 9"
    return [
        *head,
        f"case when present_{no} = 0 then {sqltext.text(ALL_BLANK)} "
        f"when {numeric} then {sqltext.text(NUMERIC_TEXT)} "
        f"when {dated} then {sqltext.text(DATE_TEXT)} else 'text' end",
        "total_rows",
        missing,
        f"case when present_{no} = 0 then 0L when {numeric} then present_{no} - number_{no} "
        f"when {dated} then present_{no} - {dates} else 0L end",
        f"blank_{no}",
    ]


def _groups(df: DataFrame, names: list[str], options: Options) -> Iterator[tuple[list[str], list[list[str]]]]:
    """(aggregates, output rows of what they count) of the named columns, by groups of columns."""
    fields = [(no, df.schema[name]) for no, name in enumerate(names, start=1)]
    for group in chunks(fields, options.aggregates_per_job // (len(DATE_LAYOUTS) + 3)):
        counts = [c for no, f in group for c in _counts(no, f)]
        yield ["count(1) as total_rows", *counts], [_row(no, f) for no, f in group]


def table_dictionary(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per column of one table, from one aggregate per group of columns.

    Labels and error counts come out of the same pass: each text column is counted
    against the number form and against every date layout, the label then picks the
    count it needs.
    """
    cleaned = missing_to_null(df)
    return union_all(
        [
            stack_rows(cleaned.selectExpr(*counts), rows, ["column_no", "column_name", *COUNTS])
            for counts, rows in _groups(df, df.columns, options)
        ]
    )


def folder_dictionary(catalog: FolderCatalog, options: Options = DEFAULTS) -> DataFrame:
    """Dictionary of all tables of a folder: tables with the same columns and types are counted
    together, so the number of plans does not depend on the number of files."""
    parts = []
    place = ["columns_before", "table_no", "table_name"]
    for family in catalog.families():
        cleaned = missing_to_null(family.rows)
        for counts, rows in _groups(family.rows, family.columns, options):
            counted = family.aggregate(cleaned, [F.expr(c) for c in counts]).na.fill(0)
            cells = [[*place, *row] for row in rows]
            parts.append(stack_rows(counted, cells, [*place, "column_no", "column_name", *COUNTS]))
    shown = union_all(parts).withColumn("slno", F.col("column_no") + F.col("columns_before"))
    return shown.select("slno", "table_no", "table_name", "column_no", "column_name", *COUNTS).orderBy("slno")


def data_dictionary(catalog: Mapping[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    """Dictionary of all tables, numbered in catalog order."""
    if isinstance(catalog, FolderCatalog) and len(catalog):
        return folder_dictionary(catalog, options)
    parts = []
    before = 0
    for table_no, (table_name, df) in enumerate(catalog.items(), start=1):
        if not df.columns:
            continue
        parts.append(
            table_dictionary(df, options).selectExpr(
                f"column_no + {before} as slno",
                f"{table_no} as table_no",
                f"{sqltext.text(table_name)} as table_name",
                "column_no",
                "column_name",
                *COUNTS,
            )
        )
        before += len(df.columns)
    return union_all(parts)


def dtype_labels(catalog: dict[str, DataFrame], options: Options = DEFAULTS) -> DataFrame:
    return data_dictionary(catalog, options).select("table_name", "column_name", F.col("data_type"))
