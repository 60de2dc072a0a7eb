"""I-Match fingerprints with randomised lexicons, and how they stand an edit.

The lexicon holds the terms whose document frequency lies in a band (an idf band) over all
documents. It is dealt at random into `SLOTS` sub-lexicons, each with ever sparser subsets
(a term is on level l with probability 2^-l-1). A text's value in a slot is the hash of its
distinct terms on the sparsest level of the slot that holds any; values are 64-bit
exclusive-ors of term hashes, which are the same for any order and so stand for the hash of
the sorted terms. Slots without a term stay empty. A text without a lexicon term is
represented by all its terms together. The likeness of two fingerprints is the share of
slots with equal values among those that either fills.

Scale: all in DataFrame functions. Document frequencies are added up before their shuffle.
The lexicon has at most (mean distinct terms / lowest frequency) terms, whatever the number
of documents, and is broadcast. Texts are shuffled once, by document; terms are never
shuffled with documents, as every step after that keeps the document's partition. Order
by id comes from range partitions and one row per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import ascii_lower, check_columns, kept, text_of, word_list

SLOTS = 32
KEY = ["nul", "kid", "h"]
ROWS_PER_RANGE = 2_000
RANGES = 4_096


def terms_of(text: Column) -> Column:
    """The distinct words, A-Z as a-z."""
    return F.array_distinct(word_list(ascii_lower(text)))


def lexicon(docs: DataFrame, lowest: float, highest: float) -> DataFrame:
    """The hashes (t) of the terms in at least `lowest` and at most `highest` of the documents.

    `docs` has the column text. A term of the lexicon is in two documents at least.
    """
    total = docs.count()
    terms = docs.select(F.explode(terms_of(F.col("text"))).alias("term"))
    counted = terms.groupBy(F.xxhash64("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    least = max(2.0, lowest * total)
    return counted.filter(F.col("df").between(least, max(least, highest * total))).select("t")


def neighbours(keys: DataFrame, rows: int) -> DataFrame:
    """keys (KEY, n, copies) in a circle: with `next` and `prev`, structs of KEY and n."""
    ranges = max(1, min(RANGES, rows // ROWS_PER_RANGE))
    placed = keys.repartitionByRange(ranges, *KEY).withColumn("part", F.spark_partition_id())
    placed = kept(placed, "imatch-order").withColumn("me", F.struct(*KEY, "n"))
    inside = Window.partitionBy("part").orderBy("me")
    ends = placed.groupBy("part").agg(F.min("me").alias("low"), F.max("me").alias("high"))
    # one row per range from here on
    by_part, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("low").over(by_part), F.min("low").over(whole)).alias("after"),
        F.coalesce(F.lag("high").over(by_part), F.max("high").over(whole)).alias("before"),
    )
    return placed.join(F.broadcast(ends), "part").select(
        *KEY,
        "n",
        "copies",
        F.coalesce(F.lead("me").over(inside), F.col("after")).alias("next"),
        F.coalesce(F.lag("me").over(inside), F.col("before")).alias("prev"),
    )


def prints(texts: DataFrame, lexicon_terms: DataFrame) -> DataFrame:
    """(KEY, variant, slots, rest) of the texts (KEY, variant, text) that have a term."""
    t = F.col("t")
    random = F.xxhash64(t, F.lit(5)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    level = F.bit_count(F.bitwise_not(random).bitwiseAND(random - 1))
    slot = F.pmod(F.xxhash64(t, F.lit(6)), F.lit(SLOTS)).cast("int")
    terms = texts.select(*KEY, "variant", F.explode(terms_of(F.col("text"))).alias("term"))
    terms = terms.select(*KEY, "variant", F.xxhash64("term").alias("t"))
    marked = terms.join(F.broadcast(lexicon_terms.withColumn("known", F.lit(True))), "t", "left")
    known = F.col("known").isNotNull()
    levels = marked.groupBy(
        *KEY,
        "variant",
        F.when(known, slot).otherwise(F.lit(-1)).alias("slot"),
        F.when(known, level).otherwise(F.lit(0)).alias("level"),
    ).agg(F.bit_xor("t").alias("value"))
    slots = levels.groupBy(*KEY, "variant", "slot").agg(F.max_by("value", "level").alias("value"))
    wide = slots.groupBy(*KEY, "variant").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"s{s}") for s in range(SLOTS)],
        F.max(F.when(F.col("slot") == -1, F.col("value"))).alias("rest"),
    )
    columns = [F.col(f"s{s}") for s in range(SLOTS)]
    filled = F.coalesce(*columns).isNotNull()
    return wide.select(
        *KEY,
        "variant",
        F.struct(F.when(filled, F.array(*columns)).alias("slots"), F.when(~filled, F.col("rest")).alias("rest")).alias("p"),
    )


def as_string(p: str) -> Column:
    """The fingerprint as text: eight hexadecimal digits per slot, or one value for all terms."""
    short = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    slots = F.array_join(F.transform(f"{p}.slots", lambda x: F.coalesce(short(x), F.lit("-" * 8))), "")
    rest = F.concat(F.lit("all:"), F.lpad(F.lower(F.hex(f"{p}.rest")), 16, "0"))
    return F.coalesce(slots, rest, F.lit("none"))


def likeness(p: str, q: str) -> Column:
    """The share of equal slots; 1 or 0 where a text has no lexicon term."""
    a, b = F.col(f"{p}.slots"), F.col(f"{q}.slots")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    equal = F.size(F.filter(pairs, lambda z: F.coalesce(z.x == z.y, F.lit(False))))
    either = F.size(F.filter(pairs, lambda z: z.x.isNotNull() | z.y.isNotNull()))
    both = a.isNotNull() & b.isNotNull()
    same = a.isNull() & b.isNull() & F.col(f"{p}.rest").eqNullSafe(F.col(f"{q}.rest"))
    return F.when(both, equal / either).otherwise(same.cast("double"))


def _on(names: list[str], other: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{other}.{c}") for c in names])


def fingerprint_edits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lowest: float = 0.001,
    highest: float = 0.05,
) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the
    first as many of the next document. Documents stand in a circle by id, null ids last,
    equal ids by the MD5 of their text; rows that repeat an id and its text are one document
    there and give equal rows. A null text is empty; texts without a word have the
    fingerprint "none". Other columns are not read; an empty table gives no rows.
    """
    check_columns(docs, [id_col, text_col])
    number = F.col(id_col).cast("long")
    rows = docs.select(
        number.isNull().alias("nul"),
        F.coalesce(number, F.lit(0)).alias("kid"),
        F.md5(text_of(text_col)).alias("h"),
        text_of(text_col).alias("text"),
    )
    keys = rows.select(*KEY, F.char_length("text").cast("long").alias("n")).groupBy(*KEY).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    total, most = docs.count(), 0
    ring = kept(neighbours(keys, total), "imatch-ring")
    most = ring.agg(F.max("copies")).first()[0] or 1
    known = kept(lexicon(rows, lowest, highest), "imatch-lexicon")

    once = rows if most == 1 else rows.dropDuplicates(KEY)
    text = once.join(ring, KEY)
    heads = text.select(
        F.col("prev.nul").alias("nul"),
        F.col("prev.kid").alias("kid"),
        F.col("prev.h").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"),
    )
    edited = text.join(heads, KEY).withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), F.col("head")),
    )
    variants = F.array(
        F.struct(F.lit(0).alias("variant"), F.col("text")),
        F.struct(F.lit(1).alias("variant"), F.col("edited").alias("text")),
    )
    printed = prints(edited.select(*KEY, F.explode(variants).alias("v")).select(*KEY, "v.*"), known)
    facts = edited.select(*KEY, "n", "copies", "next", F.sha2("edited", 256).alias("edited_sha256"))
    own = printed.filter("variant = 0").select(*KEY, F.col("p").alias("p0"))
    other = printed.filter("variant = 1").select(*KEY, F.col("p").alias("p1"))
    found = kept(facts.join(own, KEY, "left").join(other, KEY, "left"), "imatch-prints")

    after = found.select(*[F.col(c).alias(f"x_{c}") for c in KEY], F.col("p0").alias("p2"))
    near = reduce(lambda x, y: x & y, [F.col(f"next.{c}") == F.col(f"x_{c}") for c in KEY])
    out = found.join(after, near)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.when(~F.col("nul"), F.col("kid")).alias(id_col),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_string("p0").alias("fingerprint"),
        as_string("p1").alias("edited_fingerprint"),
        likeness("p0", "p1").alias("near_edited"),
        likeness("p0", "p2").alias("near_next"),
    )
