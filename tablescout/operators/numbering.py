"""Row numbers over a whole table, without moving the table through one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescout.operators.columns import col
from tablescout.session import written

POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these


def number_rows(
    df: DataFrame, order_by: list[str], within: list[str] | None = None, name: str = "row_no"
) -> DataFrame:
    """Add 1, 2, 3 .. in the given order, starting again per group if within is given.

    Rows are range-partitioned by group and order, so a group of any size is spread
    over many tasks; rows with equal keys are spread by a hash of their values, which also
    orders them. The sorted rows are written once, as Parquet: their positions must not
    change while the partition offsets are worked out, and later steps read only the columns
    and row groups they need. Columns that Parquet cannot hold (of type void) come back as
    NULL in their place.
    """
    hashable = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*[col(c) for c in (within or []) + order_by], F.xxhash64(*hashable)]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    placed = written(placed.drop(*void), "numbered")
    if void:
        placed = placed.select(*[F.lit(None).alias(c) if c in void else col(c) for c in df.columns], "_at")
    part = F.shiftright("_at", POSITION_BITS)
    position = F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    # one row per partition, also on the broadcast side of the join
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_offset") + 1)
        .drop("_part", "_at", "_offset")
    )
    if not within:
        return numbered
    starts = numbered.groupBy(
        *[col(c).alias(f"_g{i}") for i, c in enumerate(within)]
    ).agg(F.min(name).alias("_start"))
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_g{i}").eqNullSafe(col(c)) for i, c in enumerate(within)],
    )
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col(name) - F.col("_start") + 1)
        .drop("_start", *[f"_g{i}" for i in range(len(within))])
    )


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """df with running sums within a group of any size.

    Rows are range-partitioned; a window covers one partition's part of a group, and what
    earlier partitions hold of the group is a row per partition and group.
    """
    placed = df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    placed = written(placed, "running")
    inside = Window.partitionBy("_part", *group).orderBy(order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *group).agg(*[F.sum(x).alias(f"_{n}") for n, x in sums.items()])
    earlier = totals.select(
        "_part", *group, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    joined = placed.join(F.broadcast(earlier), ["_part", *group])
    summed = joined.select("*", *[(F.sum(x).over(inside) + F.col(f"_{n}")).alias(n) for n, x in sums.items()])
    return summed.drop("_part", *[f"_{n}" for n in sums])
