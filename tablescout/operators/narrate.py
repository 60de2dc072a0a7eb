"""Rows, tables and documents as spoken-style English."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import words
from tablescout.functions.text import strip
from tablescout.operators.columns import col, with_order
from tablescout.operators.describe import shown_cell
from tablescout.operators.numbering import number_rows

BLOCKS_PER_PIECE = 1000


def normalize_text(df: DataFrame, column: str) -> DataFrame:
    """Amounts, then percentages, then plain numbers of a text column as words."""
    spoken = df
    for speak in (words.speak_currency, words.speak_percent, words.speak_numbers):
        # one projection per pass: each pass reads the result of the one before
        spoken = spoken.withColumn(column, speak(col(column)))
    return spoken


def integer_words(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the words of an integer column."""
    return df.withColumn(name, words.int_to_words(col(column)))


def _headers(df: DataFrame) -> list[str]:
    return [name.strip() or f"column {i}" for i, name in enumerate(df.columns, start=1)]


def describe_rows(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """(row_no, text): ``Row i: h1 is v1; h2 is v2.`` for every row."""
    keyed, keys = with_order(df, order_by)
    # values are numbered, not sentences: those are made once, after the shuffle
    cells = [
        (shown_cell(df, f.name) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name)).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    numbered = number_rows(keyed.select(*keys, *cells), keys)
    said = [
        F.concat(F.lit(f"{header} is "), F.coalesce(F.nullif(_stripped(numbered, f"c{i}"), F.lit("")), F.lit("blank")))
        for i, header in enumerate(_headers(df))
    ]
    return numbered.select(
        "row_no",
        F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.concat_ws("; ", *said), F.lit(".")).alias(
            "text"
        ),
    )


def _stripped(df: DataFrame, name: str) -> Column:
    """Text of a cell without white space around it; that of a number, truth value or date has none."""
    shown = shown_cell(df, name)
    bare = isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType, T.DateType))
    return shown if bare else strip(shown)


def describe_table(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """(row_no, text): a structure sentence as row 0, then one sentence per row."""
    structure = F.concat(
        F.lit(f"Table with {len(df.columns)} columns and "),
        F.count(F.lit(1)).cast("string"),
        F.lit(f" data rows. The columns are: {', '.join(_headers(df))}."),
    )
    head = df.agg(structure.alias("text")).select(F.lit(0).cast("bigint").alias("row_no"), "text")
    return head.unionByName(describe_rows(df, order_by))


def assemble_document(blocks: DataFrame) -> DataFrame:
    """(doc_id, text) of blocks (doc_id, seq, style, text), blank blocks left out.

    Joined in two steps, by stretches of seq first, so that the blocks of a very long
    document are put together in several tasks.
    """
    text = strip(F.col("text"))
    style = F.lower(F.coalesce(F.col("style"), F.lit("")))
    spoken = (
        F.when(
            style.contains("heading") | style.contains("title"),
            F.concat(F.lit("Heading: "), text, F.lit(".")),
        )
        .when(style.contains("list"), F.concat(F.lit("Bullet point: "), text, F.lit(".")))
        .otherwise(text)
    )
    piece = F.floor(F.col("seq") / BLOCKS_PER_PIECE)

    def joined(key: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(key, "spoken")))
        return F.array_join(F.transform(entries, lambda e: e["spoken"]), "\n\n")

    return (
        blocks.where(text != "")
        .select("doc_id", "seq", piece.alias("piece"), spoken.alias("spoken"))
        .groupBy("doc_id", "piece")
        .agg(joined("seq").alias("spoken"))
        .groupBy("doc_id")
        .agg(joined("piece").alias("text"))
    )
