import random

from pyspark.sql import functions as F

from tablescout.operators import narrate
from tablescout.operators.numbering import number_rows


def test_numbers_over_many_partitions(spark):
    rng = random.Random(4)
    keys = rng.sample(range(100_000), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(9)
    got = {r["k"]: r["row_no"] for r in number_rows(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), start=1)}


def test_numbers_within_groups_and_null_groups(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 2 else f"g{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(6)
    got = {r["k"]: r["row_no"] for r in number_rows(df, ["k"], within=["g"]).collect()}
    seen, want = {}, {}
    for g, k in rows:
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert got == want


def test_table_as_sentences(spark):
    df = spark.createDataFrame([(2, None, 1.0), (1, "  ", 2e7)], "`id` int, ` ` string, v double")
    rows = narrate.describe_table(df, ["id"]).orderBy("row_no").collect()
    assert [r["text"] for r in rows] == [
        "Table with 3 columns and 2 data rows. The columns are: id, column 2, v.",
        "Row 1: id is 1; column 2 is blank; v is 20000000.0.",
        "Row 2: id is 2; column 2 is blank; v is 1.0.",
    ]
    as_read = narrate.describe_rows(df.coalesce(1), None).orderBy("row_no").first()
    assert as_read["text"].startswith("Row 1: id is 2;")


def test_values_are_numbered_and_sentences_made_after(spark, monkeypatch):
    moved = []

    def seen(df, keys):
        moved.append(dict(df.dtypes))
        return number_rows(df, keys)

    monkeypatch.setattr(narrate, "number_rows", seen)
    df = spark.sql("select 2 as _at, 1.5d as row_no, map('a', 1) as _part, ' x\\t' as v, cast(null as int) as c0, null as n")
    got = narrate.describe_rows(df, ["_at"]).first()
    assert tuple(got) == (1, "Row 1: _at is 2; row_no is 1.5; _part is {a -> 1}; v is x; c0 is blank; n is blank.")
    assert list(moved[0].values()) == ["int", "int", "double", "string", "string", "int", "void"]


def test_long_documents_keep_their_order(spark):
    blocks = spark.range(5000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("seq"), F.lit("Normal").alias("style"),
        F.concat(F.lit(" b"), F.col("id").cast("string"), F.lit("\n")).alias("text"),
    ).repartition(7)
    text = narrate.assemble_document(blocks).first()["text"]
    assert text == "\n\n".join(f"b{i}" for i in range(5000))


def test_block_styles(spark):
    rows = [(1, "Heading 1", " H "), (2, "List Bullet", "x"), (3, None, "t"), (4, "Title", "T"), (5, "x", " \t"), (6, "body", "e")]
    df = spark.createDataFrame([(9, *r) for r in rows], "doc_id int, seq int, style string, text string")
    assert narrate.assemble_document(df).first()["text"] == "Heading: H.\n\nBullet point: x.\n\nt\n\nHeading: T.\n\ne"
