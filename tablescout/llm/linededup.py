"""Drop lines by their frequency within a site.

For every host the share of its pages that contain a line is worked out over all pages.
Lines above `ratio`, on at least `min_pages` pages, are boilerplate of that host and go
from all its pages. By default every row is a page of its own, and a page made of such lines
only is taken for a copy of other pages and keeps its text; `distinct_pages` counts pages
with the same text once, without `whole_pages` the lines go there too.

Scale: a page sends each of its lines once, as a 128-bit hash, and counts are added up
before the shuffle, so a line or host of any weight costs little. By its definition a host
has at most (lines per page / ratio) boilerplate lines; they travel as one list per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, kept, text_of

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A 128-bit key of a line without the white space around it; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    key = F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))
    return F.when(bare != "", key)


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without port and user; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def boilerplate_lines(
    docs: DataFrame, text_col: str, host_col: str, ratio: float, min_pages: int, distinct_pages: bool = False
) -> DataFrame:
    """One row per host with boilerplate: host, bad (its line keys)."""
    pages = docs.select(F.col(f"`{host_col}`").cast("string").alias("host"), text_of(text_col).alias("text"))
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    pages = pages.select("host", keys.alias("keys"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit("page"), "text").alias("b"))
    if distinct_pages:
        pages = pages.dropDuplicates(["host", "a", "b"])
    lines = pages.select("host", F.explode("keys").alias("key")).filter("key is not null")
    counted = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    totals = totals.select(F.col("host").alias("h"), "total")
    often = counted.filter(F.col("pages") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("h")))
    return (
        often.filter(F.col("pages") / F.col("total") > ratio)
        .groupBy("host")
        .agg(F.collect_list("key").alias("bad"))
    )


def drop_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = 0.02,
    min_pages: int = 3,
    distinct_pages: bool = False,
    whole_pages: bool = True,
) -> DataFrame:
    """docs with the text cleaned, plus n_lines and n_dropped of every row.

    Lines end at \\n and are compared without the white space around them; blank lines
    always stay. A null text stays null with 0 lines; an empty text has one blank line.
    Rows without a host form one host. Repeated rows count as pages of their own, with
    `distinct_pages` once for each text of a host. A page of boilerplate lines only stays as it
    is, without `whole_pages` it keeps its blank lines or becomes an empty text. Columns that
    already bear the name n_lines or n_dropped are replaced; an empty table gives no rows.
    """
    check_columns(docs, [text_col, host_col])
    docs = docs.drop("n_lines", "n_dropped")
    bad = kept(boilerplate_lines(docs, text_col, host_col, ratio, min_pages, distinct_pages), "boilerplate")
    # the input row travels as one column, so that its names meet no others
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.split(F.col(f"`{text_col}`").cast("string"), "\n").alias("lines"),
        F.col(f"`{host_col}`").cast("string").alias("of"),
    )
    joined = packed.join(bad, F.col("of").eqNullSafe(F.col("host")), "left")
    fine = F.filter(
        "lines", lambda x: ~F.coalesce(F.array_contains(F.col("bad"), line_key(x)), F.lit(False))
    )
    cleaned = joined.withColumn("fine", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(fine))
    if whole_pages:
        some = F.exists("fine", lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        cleaned = cleaned.withColumn("fine", F.when(some, F.col("fine")).otherwise(F.col("lines")))
    return cleaned.select(
        *[
            (F.array_join("fine", "\n") if c == text_col else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ],
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("fine"), F.lit(0)).alias("n_dropped"),
    )
