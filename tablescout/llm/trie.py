"""The prefix trie of conversations, from digests of blocks of turns.

A turn becomes a 128-bit hash of its place, role and text; a prefix is the exclusive-or of
its turns' hashes, so prefixes of any length follow from partial results. Conversations are
grouped by the digests of their prefixes up to the end of each block of `block` turns first.
Where all conversations of a group go on with the same block, the nodes inside that block have
the group's members and nothing is looked at turn by turn. Only where siblings diverge (or
some end) the turns inside are compared, and there once for each different block, weighted by
its conversations. Sums over subtrees follow the same way: a node's value belongs to its
smallest conversation, what lies behind a block is added up by block, and one conversation for
each block adds what lies inside it.

Scale: texts are hashed and measured at the start and travel no further than the numbering of
the turns. All groups are counted with partial sums; a first turn shared by any number of
conversations is one row a task. Windows cover a block, or stretches of blocks, so that a
conversation of any length is spread. The number of steps does not depend on the depth. The
numbers of an end node's members must meet in one row, as their digest is asked for; they
come there as strings of up to 4,096.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.common import check_columns, kept, text_of
from tablescout.operators.numbering import number_rows

BLOCK = 4
# blocks of a conversation that one window covers
STRETCH = 1_024
ENDS_BITS = 12

KEY = ["depth", "z1", "z2"]


def _zero() -> Column:
    return F.lit(0).cast("long")


def _xor(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.bitwiseXOR(b)


def hashed_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, place, a, b, n_bytes): turns numbered from 0 in each conversation, as hashes.

    Turns are ordered by turn, null first, equal ones by role and text; null roles and texts are
    empty. Rows without a conversation id belong to no conversation and have no place here.
    """
    check_columns(turns, [id_col, turn_col, role_col, text_col])
    plain = turns.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
    ).filter("conv is not null")
    numbered = number_rows(plain, ["turn", "role", "text"], within=["conv"], name="place")
    return numbered.select(
        "conv",
        (F.col("place") - 1).cast("long").alias("place"),
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("turn"), F.col("text"), F.col("role")).alias("b"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


def _running(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows (conv, k and values) with the values' running totals, as r_<name>; kinds are sum or
    bit_xor. A window covers STRETCH blocks; stretches of a conversation are added up first."""
    plus = {"sum": lambda a, b: a + b, "bit_xor": _xor}
    make = {"sum": F.sum, "bit_xor": F.bit_xor}
    rows = rows.withColumn("far", F.floor(F.col("k") / STRETCH))
    totals = rows.groupBy("conv", "far").agg(*[make[f](n).alias(f"t_{n}") for n, f in kinds.items()])
    before = Window.partitionBy("conv").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "conv", "far", *[F.coalesce(make[f](f"t_{n}").over(before), _zero()).alias(f"t_{n}") for n, f in kinds.items()]
    )
    inside = Window.partitionBy("conv", "far").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(totals, ["conv", "far"])
    return joined.select(
        *[c for c in rows.columns if c != "far"],
        *[plus[f](make[f](n).over(inside), F.col(f"t_{n}")).alias(f"r_{n}") for n, f in kinds.items()],
    )


def _ends(blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """The digest of the conversations that end at a node."""
    last = blocks.groupBy("conv").agg(F.max(F.struct("k", "m", "p1", "p2")).alias("at"))
    ended = convs.join(last, "conv", "left").select(
        "conv",
        F.coalesce(F.col("at.k") * block + F.col("at.m"), _zero()).alias("depth"),
        F.coalesce("at.p1", _zero()).alias("z1"),
        F.coalesce("at.p2", _zero()).alias("z2"),
    )
    ended = ended.withColumn("part", F.shiftright("conv", ENDS_BITS))
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    parts = ended.groupBy(*KEY, "part").agg(F.array_join(ids, ",").alias("ids"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])
    return parts.groupBy(*KEY).agg(F.sha2(F.array_join(lists, ","), 256).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `turns` has conv, place (0, 1, .. in each conversation), a, b (hashes) and n_bytes; `convs`
    one row for each conversation, also those without turns, which are members of the root.
    saved_tokens are the bytes that need no second reading when prefixes are shared: over the
    subtree, each node's (n_convs - 1) times the bytes of its last turn. Conversations of equal
    turns share all nodes. No conversations give no nodes.
    """
    turns = kept(turns.select(
        "conv", "place", F.floor(F.col("place") / block).alias("k"), "n_bytes",
        F.xxhash64("place", "a", "b").alias("x1"), F.xxhash64(F.lit("prefix"), "b", "place", "a").alias("x2"),
    ), "turns")
    convs = kept(convs.select("conv"), "conversations")
    # scalars: how many conversations, and the first
    n_all, first = convs.agg(F.count("conv"), F.min("conv")).first()
    blocks = turns.groupBy("conv", "k").agg(
        F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"), F.count(F.lit(1)).alias("m")
    )
    blocks = _running(blocks, {"y1": "bit_xor", "y2": "bit_xor"}).select(
        "conv", "k", "m", F.col("r_y1").alias("p1"), F.col("r_y2").alias("p2"),
        _xor("r_y1", "y1").alias("q1"), _xor("r_y2", "y2").alias("q2"),
    )
    blocks = kept(blocks, "blocks")

    # conversations that agree up to the end of a block, and what they come from
    groups = blocks.groupBy("k", "m", "p1", "p2", "q1", "q2").agg(F.count("conv").alias("n"), F.min("conv").alias("conv"))
    groups = kept(groups, "groups")
    above = groups.select((F.col("k") + 1).alias("k"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("n").alias("n_above"))
    groups = groups.join(above, ["k", "q1", "q2"], "left")
    n_above = F.coalesce("n_above", F.when(F.col("k") == 0, F.lit(n_all)))
    groups = groups.withColumn("same", F.col("n") == n_above).drop("m", "n_above")
    # the turns of one conversation for each group, with their prefixes
    upto = Window.partitionBy("conv", "k").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = turns.join(groups, ["conv", "k"]).select(
        "conv", "k", "place", (F.col("place") + 1).alias("depth"), "n_bytes", "n", "same", "p1", "p2", "x1", "x2",
        _xor("q1", F.bit_xor("x1").over(upto)).alias("z1"), _xor("q2", F.bit_xor("x2").over(upto)).alias("z2"),
    )
    inside = inside.withColumns({"b1": _xor("z1", "x1"), "b2": _xor("z2", "x2")}).drop("x1", "x2")
    inside = kept(inside, "inside")

    columns = [*KEY, "b1", "b2", "n", "conv", "n_bytes"]
    refined = inside.filter("not same").groupBy(*KEY).agg(
        F.max("b1").alias("b1"), F.max("b2").alias("b2"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.max("n_bytes").alias("n_bytes"),
    )
    nodes = refined.select(columns).unionByName(inside.filter("same").select(columns))
    root = convs.sparkSession.createDataFrame(
        [(0, 0, 0, None, None, n_all, first, 0)] if n_all else [],
        ", ".join(f"{c} bigint" for c in columns),
    )
    nodes = kept(nodes.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("b1").alias("z1"), F.col("b2").alias("z2")]
    children = nodes.filter("depth > 0").select(up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("z1").alias("b1"), F.col("z2").alias("b2"), F.col("conv").alias("parent_conv_id")
    )
    nodes = nodes.join(children, KEY, "left").join(parents, ["depth", "b1", "b2"], "left").select(
        *KEY, "conv", "n", "n_bytes", "parent_conv_id", F.coalesce("n_children", _zero()).alias("n_children")
    )
    nodes = nodes.withColumns({
        "own": (F.col("n") - 1) * F.col("n_bytes"), "leaf": (F.col("n_children") == 0).cast("long")
    })
    nodes = kept(nodes, "linked")

    # what a conversation's own nodes hold behind each of its blocks, added up by group
    owned = nodes.filter("depth > 0").select("conv", F.floor((F.col("depth") - 1) / block).alias("k"), "own", "leaf")
    owned = owned.groupBy("conv", "k").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    owned = kept(owned, "owned")
    whole = owned.groupBy("conv").agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("all_leaf"))
    passed = blocks.select("conv", "k", "p1", "p2").join(owned, ["conv", "k"], "left").fillna(0, ["own", "leaf"])
    passed = _running(passed.join(whole, "conv"), {"own": "sum", "leaf": "sum"})
    behind = passed.select(
        "k", "p1", "p2", (F.col("all_own") - F.col("r_own")).alias("own"), (F.col("all_leaf") - F.col("r_leaf")).alias("leaf")
    )
    behind = behind.groupBy("k", "p1", "p2").agg(F.sum("own").alias("behind_own"), F.sum("leaf").alias("behind_leaf"))
    below = Window.partitionBy("conv", "k").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    added = inside.join(behind, ["k", "p1", "p2"], "left").join(
        nodes.select("conv", "depth", "own", "leaf"), ["conv", "depth"], "left"
    ).select(
        *KEY,
        *[
            (F.coalesce(F.sum(c).over(below), _zero()) + F.coalesce(f"behind_{c}", _zero())).alias(c)
            for c in ("own", "leaf")
        ],
    )
    sums = added.groupBy(*KEY).agg(F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    # the root has everything; it is the only leaf where nobody has said anything
    top = owned.agg(F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).select(
        *[_zero().alias(c) for c in KEY], F.coalesce("saved_tokens", _zero()).alias("saved_tokens"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
    )
    parts = [nodes, sums.unionByName(top), _ends(blocks, convs, block)]
    joined = reduce(lambda a, b: a.join(b, KEY, "left"), parts)
    return joined.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The trie of the conversations as they are; see prefix_trie and hashed_turns."""
    numbered = kept(hashed_turns(turns, id_col, turn_col, role_col, text_col), "numbered")
    return prefix_trie(numbered, numbered.select("conv").distinct(), block)


def spliced(numbered: DataFrame, near: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after every conversation c took over the first h = crc32(c) % most
    turns of conversation c - c % near, followed by its own turns after its first h."""
    convs = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % near).alias("base"),
        (F.crc32(F.col("conv").cast("string")) % most).alias("h"),
    )
    convs = kept(convs, "spliced")
    heads = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = kept(convs.join(heads, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", _zero())).alias("taken")
    ), "spliced")
    columns = ["conv", "place", "a", "b", "n_bytes"]
    own = numbered.join(convs, "conv").filter("place >= h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken")).select(columns)
    first = numbered.filter(F.col("place") < most).withColumnRenamed("conv", "base")
    first = first.join(convs, "base").filter("place < h").select(columns)
    return own.unionByName(first), convs.select("conv")


def spliced_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations that share beginnings as spliced makes them."""
    return prefix_trie(*spliced(kept(hashed_turns(turns), "numbered")))
