"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import kept


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges u, v; the component is its smallest node.

    Large stars hang a node's larger neighbours below its smallest one, small stars the
    smaller ones; both repeat until nothing changes, in about log(diameter) rounds. Every
    step is an aggregate with partial sums and a join that adaptive execution may split, so
    a node with any number of neighbours is no bottleneck. Rounds are cut by written tables.
    Self links and null ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = kept(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the smallest neighbour
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        large = kept(large, "edges")
        # small star: u and its neighbours below go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        edges = kept(edges, "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return hung.unionByName(roots)
