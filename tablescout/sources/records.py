"""Records of delimited files whose quoted fields span lines, without keeping a file whole.

Whether a line lies inside a quoted field depends on all lines before it. But a line can only
do one of four things to that state: keep it, end inside, end outside, or turn it round; and
steps like these can be put together in any grouping. So every split works out its own lines
by itself, one row per split carries the state on, and lines that belong together meet by the
number of the record's first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.session import written

QUOTE = '"'


def quote_pieces(line: Column) -> Column:
    return F.split(line, QUOTE, -1)


def ends_inside(pieces: Column, separator: Column | str, inside: bool = False) -> Column:
    """Whether a line ends inside a quoted field, given its pieces between quotes.

    A field is quoted when its first character is a quote; two quotes inside stand for one.
    Any other quote is part of the text, like an inch mark.
    """
    separator = F.lit(separator) if isinstance(separator, str) else separator
    last = F.size(pieces) - 1
    outside, within, pair = 0, 1, 2

    def step(state: Column, i: Column) -> Column:
        before, after = F.get(pieces, i - 1), F.get(pieces, i)
        opens = ((i == 1) & (before == "")) | F.endswith(before, separator)
        return (
            F.when(state == pair, within)
            .when(state == outside, F.when(opens, within).otherwise(outside))
            .otherwise(F.when((after == "") & (i < last), pair).otherwise(outside))
        )

    start = F.lit(within if inside else outside)
    return F.when(last > 0, F.aggregate(F.sequence(F.lit(1), last), start, step) == within).otherwise(inside)


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, at, line): a line's split and its order in it."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("line"),
        )
    )


def judged_lines(lines: DataFrame, separator: str) -> DataFrame:
    """Lines with the state they lead to from outside and from inside a quoted field; written,
    as the places of lines must stay."""
    cut = lines.withColumn("pieces", quote_pieces(F.col("line")))
    judged = cut.select(
        "file", "block", "at", "line",
        ends_inside(F.col("pieces"), separator).alias("from_outside"),
        ends_inside(F.col("pieces"), separator, inside=True).alias("from_inside"),
    )
    return written(judged, "lines")


def _state(fixed: Column, turns: Column, start: Column) -> Column:
    """Inside or not: the state that the last line of fixed outcome left, or else the state at
    the start, turned round by each line since that turns."""
    since = (turns - F.coalesce(fixed["turns"], F.lit(0))) % 2 == 1
    return F.coalesce(fixed["ends"], start) != since


def records(judged: DataFrame) -> DataFrame:
    """(file, block, at, record, is_header): the records in full, at the place of their first line.

    A quote that is never closed opens nothing: the lines from there on stay lines. The first
    record of a file that is not blank is its header.
    """
    turn = (F.col("from_outside") & ~F.col("from_inside")).cast("long")
    is_fixed = F.col("from_outside") == F.col("from_inside")
    split = Window.partitionBy("file", "block").orderBy("at")
    upto, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    lines = judged.withColumn("turns", F.sum(turn).over(upto))
    fixed = F.when(is_fixed, F.struct(F.col("from_outside").alias("ends"), "turns"))
    lines = lines.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    lines = lines.withColumn("turns_before", F.col("turns") - turn)

    # one row per split: what it does to the state, and the state that it starts with
    last = F.struct("at", F.col("from_outside").alias("ends"), "turns")
    splits = lines.groupBy("file", "block").agg(
        F.max(F.when(is_fixed, last)).alias("fixed"), F.sum(turn).alias("turns"),
        F.min(F.when(F.trim("line") != "", F.col("at"))).alias("first"),
    )
    across = Window.partitionBy("file").orderBy("block")
    so_far, ahead = across.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("all_turns", F.sum("turns").over(so_far))
    known = F.when(
        F.col("fixed").isNotNull(),
        F.struct(
            F.col("fixed.ends").alias("ends"),
            (F.col("all_turns") - F.col("turns") + F.col("fixed.turns")).alias("turns"),
        ),
    )
    outside = F.lit(False)
    splits = splits.withColumn("known", F.last(known, ignorenulls=True).over(ahead)).select(
        "file", "block", "first",
        _state(F.col("known"), F.col("all_turns") - F.col("turns"), outside).alias("starts_inside"),
    )
    lines = lines.join(splits.drop("first"), ["file", "block"])
    inside = _state(F.col("fixed"), F.col("turns_before"), F.col("starts_inside"))
    lines = lines.select("file", "block", "at", "line", inside.alias("inside"), F.when(
        inside, F.col("from_inside")).otherwise(F.col("from_outside")).alias("after"))

    # the first line of each line's record; for a split's first lines it is in an earlier one
    head = F.when(~F.col("inside"), F.struct("block", "at"))
    lines = lines.withColumn("head", F.last(head, ignorenulls=True).over(upto))
    ends = lines.groupBy("file", "block").agg(F.max(head).alias("own"), F.max_by("after", "at").alias("open"))
    carried = ends.select(
        "file", "block",
        F.last("own", ignorenulls=True).over(ahead).alias("carried"),
        # where the file ends inside a field, that field's line
        F.last(F.struct(F.last("own", ignorenulls=True).over(so_far).alias("head"), "open")).over(
            Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("end"),
    )
    lines = lines.join(carried, ["file", "block"]).withColumn("head", F.coalesce("head", "carried"))
    never_closed = F.col("end.open") & (F.col("head") == F.col("end.head"))
    lines = lines.withColumn("head", F.when(never_closed, F.struct("block", "at")).otherwise(F.col("head")))
    single = never_closed | (~F.col("inside") & ~F.col("after"))
    starts = splits.filter("first is not null").groupBy("file").agg(F.min(F.struct("block", F.col("first").alias("at"))).alias("start"))
    lines = lines.withColumn("single", single).join(starts, "file", "left")
    header = F.coalesce(F.col("head") == F.col("start"), F.lit(False))
    alone = lines.filter("single").select("file", "block", "at", F.col("line").alias("record"), header.alias("is_header"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"])
    joined = lines.filter("not single").groupBy("file", "head", header.alias("is_header")).agg(
        F.array_join(parts, "\n").alias("record")
    )
    return alone.unionByName(joined.select("file", "head.block", "head.at", "record", "is_header"))
