"""The corpus pipeline: documents through five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import broadcast_if_small, kept, shuffles_go, table, text_of
from tablescout.llm.decontaminate import find_leaks
from tablescout.llm.linededup import drop_boilerplate
from tablescout.llm.mixing import mix_sources
from tablescout.llm.ngramjoin import ngram_jaccard_join
from tablescout.llm.quality import quality_scores


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; the others go.

    Columns of any name pass through, also those that the classifier adds itself.
    """
    packed = _packed(docs, "doc_id", "text")
    scored = quality_scores(packed, table(spark, sf_dir, "labels"), keep=("row", "text"))
    return _unpacked(scored.filter("predicted = 1"), docs, "doc_id", "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text.

    Copies of a page count once: their content is no boilerplate. Columns of any name pass through.
    """
    cleaned = drop_boilerplate(_packed(docs, "source", "text"), distinct_pages=True)
    length = F.char_length("text").cast("long")
    return _unpacked(cleaned, docs, "source", "text").withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that share 80 % of their five-word shingles the one with the smallest id stays.

    Repeated rows are such rows. Rows without an id come last; equal ids go by the MD5 of the
    text. A text without words is like no other and stays.
    """
    with shuffles_go(spark):
        docs, key = _numbered(docs, "near-rows")
        joined = ngram_jaccard_join(docs, id_col=key, size=5, percent=80)
        linked = joined.select(F.col(key), F.col("component_id").alias("of"))
        # only rows of groups with more than one compete
        groups = kept(linked.filter(F.col(key) != F.col("of")).select("of").distinct(), "near-groups")
        many = groups.count()
        linked = linked.join(broadcast_if_small(groups, many), "of", "left_semi")
        rank = docs.select(key, F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(text_of("text")), key).alias("rank"))
        linked = kept(linked.join(rank, key), "near-linked")
        first = linked.groupBy("of").agg(F.min("rank").getField(key).alias("stays"))
        gone = linked.join(broadcast_if_small(first, many), "of").filter(F.col(key) != F.col("stays")).select(key)
        return _without(docs, gone, key, "near-gone")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    docs, key = _numbered(docs, "leak-rows")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(docs, leaks.select(key).distinct(), key, "leaks")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of every document the mix takes."""
    return mix_sources(docs)


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """Some columns by themselves, the others in one struct, where their names meet no others."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*(others or [F.lit(True).alias("none")])).alias("row"))


def _unpacked(packed: DataFrame, docs: DataFrame, *apart: str) -> DataFrame:
    """The columns of docs again."""
    return packed.select(*[F.col(c) if c in apart else F.col("row").getField(c).alias(c) for c in docs.columns])


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs, written, with a number for every row; and the number's column name."""
    key = "row_number"
    while key in docs.columns:
        key += "_"
    return kept(docs.withColumn(key, F.monotonically_increasing_id()), label), key


def _without(docs: DataFrame, gone: DataFrame, key: str, label: str) -> DataFrame:
    """docs without key and the rows in gone, which are narrow and broadcast while they are few."""
    gone = kept(gone, label)
    return docs.join(broadcast_if_small(gone, gone.count()), key, "left_anti").drop(key)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixing),
]

# the classifier and the ranked retrieval are not SQL; tests/llm has the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
