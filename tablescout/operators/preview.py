"""Table previews and cell formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescout.functions.text import display_number
from tablescout.operators.columns import FLOAT_TYPES, col, union_all, with_order
from tablescout.operators.describe import shown_cell
from tablescout.options import DEFAULTS, Options

PREVIEW = "total_rows bigint, row_no int, cells array<string>, not_shown string"


def format_cell(df: DataFrame, name: str) -> Column:
    """Readable text of one cell: NULL spelled out, bytes decoded as UTF-8."""
    kind = df.schema[name].dataType
    c = col(name)
    if isinstance(kind, T.BinaryType):
        text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.hex(c))
    elif isinstance(kind, FLOAT_TYPES):
        text = display_number(c.cast("double"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def format_cells(df: DataFrame) -> DataFrame:
    """Every column as readable text."""
    return df.select(*[format_cell(df, c).alias(c) for c in df.columns])


def preview(df: DataFrame, order_by: list[str] | None, options: Options = DEFAULTS) -> DataFrame:
    """(total_rows, row_no, cells, not_shown): the first rows of the first columns.

    The total is counted at once. An empty table gives one row without a row number.
    """
    shown = df.columns[: options.preview_columns]
    extra = df.columns[options.preview_columns :]
    note = f"(+{len(extra)} more column(s) not shown: {', '.join(extra)})" if extra else ""
    total = df.count()
    if total == 0:
        return df.sparkSession.createDataFrame([(0, None, None, note)], PREVIEW)
    keyed, keys = with_order(df, order_by)
    first = keyed.orderBy(*keys).limit(options.preview_rows)
    # at most preview_rows rows reach this window
    return first.select(
        F.lit(total).cast("bigint").alias("total_rows"),
        F.row_number().over(Window.orderBy(*keys)).alias("row_no"),
        F.array(*[shown_cell(df, c) for c in shown]).alias("cells"),
        F.lit(note).alias("not_shown"),
    )


def table_preview(
    catalog: dict[str, DataFrame],
    order_by: dict[str, list[str] | None],
    options: Options = DEFAULTS,
) -> DataFrame:
    """Previews of all tables; a table that cannot be read keeps a row with its error."""
    parts = []
    for name, df in catalog.items():
        error = ""
        try:
            part = preview(df, order_by[name], options)
        except Exception as problem:  # noqa: BLE001 - reported, the other tables go on
            error = f"No preview: {problem}"
            part = df.sparkSession.createDataFrame([(None, None, None, "")], PREVIEW)
        parts.append(part.select(F.lit(name).alias("table_name"), "*", F.lit(error).alias("error")))
    return union_all(parts)
