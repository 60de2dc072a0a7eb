"""Mix sources to target weights with Pareto order sampling.

Targets: the budget is shared among the sources by weight; a target above `cap` times its
source's size stops there and the excess is shared again by weight until none is above.

Copies: every document of a source gets floor(target / source size) whole copies. What is
left of the target is drawn without replacement: with inclusion probability p (the
fractional part) and a uniform number u from a hash of the id, documents are ranked by
(u / (1 - u)) / (p / (1 - p)) and taken in that order up to the size that is left; the
document at the border comes in if that ends nearer to the target.

Scale: a source may hold any share of the rows. Ranks are first counted in `cells` equal
cells per source; only the documents of the one cell where a source's border lies are
sorted, so a task holds 1 / cells of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, kept, text_of, word_count

HEX_DIGITS = 13  # 52 bits of the hash


def uniform(name: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3
) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    `sized` has the columns source and size. Sources come by code point, null last, and
    take the weights in turn. The table has one row per source, so its windows are small.
    Sources without a word get the target 0. No rows give no rows.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("turn", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    )
    # sources that stop at their cap come first in the order of size per weight
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "turn")
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(share)
        - F.coalesce(
            F.sum(F.col("source_size") * cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
    ) / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    free = F.col("weight") * F.col("level") <= F.col("source_size") * cap
    rows = rows.withColumn("first_free", F.min(F.when(free, F.col("place"))).over(whole))
    rows = rows.withColumn(
        "last_level",
        F.max(F.when(F.col("place") == F.col("first_free"), F.col("level"))).over(whole),
    )
    capped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free"))
    return rows.select(
        "source",
        "source_size",
        "weight",
        F.when(capped, (F.col("source_size") * cap).cast("double"))
        .otherwise(F.col("weight") * F.col("last_level"))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    cap: int = 3,
    seed: int = 17,
    cells: int = 4096,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    Size is the number of words; a null or empty text has size 0 and is never drawn for
    words, its copies follow the same rule. A null source is a source of its own. A null id
    counts as the empty id. Equal ids share their random number: they are ranked by size,
    and identical rows are told apart by position only, so the counts do not depend on it.
    Other columns of `docs` are not read; an empty table gives no rows.
    """
    check_columns(docs, [id_col, text_col, source_col])
    sized = kept(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_of(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    targets = kept(source_targets(sized, weights, share, cap), "mix-targets")
    size = F.col("source_size").cast("double")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / size).otherwise(F.lit(0.0))
    base = F.floor(ratio)
    targets = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        base.alias("base"),
        (ratio - base).alias("p"),
        (F.col("target") - base * F.col("source_size")).alias("rest"),
    )
    u, p = uniform("id", seed), F.col("p")
    odds = F.when(p > 0, (u * (F.lit(1.0) - p)) / ((F.lit(1.0) - u) * p))
    drawn = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("odds", odds)
        .withColumn("cell", F.floor(F.col("odds") / (F.col("odds") + 1) * cells))
    )
    # the cell in which a source's running size passes what is left of its target
    running = Window.partitionBy("source").orderBy("cell")
    sums = drawn.filter("p > 0").groupBy("source", "cell").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest")
    )
    sums = sums.withColumn("upto", F.sum("words").over(running))
    border = (
        sums.filter(F.col("upto") > F.col("rest"))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("at"))
        .select("s", F.lit(True).alias("has"), F.col("at.cell").alias("edge"), F.col("at.before").alias("before"))
    )
    placed = drawn.join(kept(border, "mix-border"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_edge = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
    order = Window.partitionBy("source").orderBy("odds", "id", "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.col("upto") - F.col("size")
    nearer = (earlier < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - earlier)
    inner = (
        placed.filter(at_edge)
        .withColumn("upto", upto)
        .withColumn("extra", ((F.col("upto") <= F.col("rest")) | nearer).cast("long"))
        .drop("upto")
    )
    sure = F.col("cell").isNotNull() & (F.col("has").isNull() | (F.col("cell") < F.col("edge")))
    outer = placed.filter(~at_edge).withColumn("extra", sure.cast("long"))
    copies = F.col("base") + F.col("extra")
    return inner.unionByName(outer).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
