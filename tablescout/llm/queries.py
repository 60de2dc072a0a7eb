"""The registered queries of the package and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescout.llm import oracles
from tablescout.llm.archives import archived_pages
from tablescout.llm.common import table
from tablescout.llm.decontaminate import find_leaks
from tablescout.llm.imatch import fingerprint_edits
from tablescout.llm.langid import predict_language
from tablescout.llm.linededup import drop_boilerplate
from tablescout.llm.mixing import mix_sources
from tablescout.llm.ngramjoin import ngram_jaccard_join
from tablescout.llm.quality import quality_scores
from tablescout.llm.runs import run_report
from tablescout.llm.tokencounts import count_tokens
from tablescout.llm.toxicity import toxicity_scores
from tablescout.llm.trie import spliced_trie
from tablescout.llm.windows import repeat_report

# vocabularies of public tokenizers
TOKENIZERS = "/opt/tokenizers"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 90 % of their distinct 3-word shingles."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=3, percent=90)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; every fourth of the labels is held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 1, 2, 3 in turn and share all words."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, in all and line by line."""
    return count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; every third of the labels is held out."""
    return predict_language(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; every third of the labels is held out."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return drop_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "n_lines", "n_dropped"
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC archives, the converter and the WARC archives it writes."""
    return archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that start anywhere else."""
    return repeat_report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents."""
    return run_report(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, with shared beginnings spliced in."""
    return spliced_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_quality": op2_quality,
        "op3_mix_sources": op3_mix_sources,
        "op4_token_counts": op4_token_counts,
        "op5_language": op5_language,
        "op6_toxicity": op6_toxicity,
        "op7_line_dedup": op7_line_dedup,
        "op8_imatch": op8_imatch,
        "op9_arc_to_warc": op9_arc_to_warc,
        "op10_benchmark_leaks": op10_benchmark_leaks,
        "op11_repeated_windows": op11_repeated_windows,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": oracles.NGRAM_JOIN,
        "op3_mix_sources": oracles.MIX_SOURCES,
        "op7_line_dedup": oracles.LINE_DEDUP,
        "op9_arc_to_warc": oracles.ARC_TO_WARC,
        "op11_repeated_windows": oracles.REPEATED_WINDOWS,
        "op12_periodic_runs": oracles.PERIODIC_RUNS,
        "op13_conversation_trie": oracles.CONVERSATION_TRIE,
    }
