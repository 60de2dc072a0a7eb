"""The fixed report sequences over a whole catalog or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescout.operators.clusters import cluster_report
from tablescout.operators.correlate import correlation_report
from tablescout.operators.describe import describe_tables
from tablescout.operators.dictionary import data_dictionary
from tablescout.operators.keys import key_candidates
from tablescout.operators.outliers import outlier_report
from tablescout.operators.similarity import column_similarity
from tablescout.options import DEFAULTS, Options
from tablescout.sources.catalog import load_folder
from tablescout.sources.sinks import write_reports

SKIPPED = "Skipped by user request"


def profile(
    catalog: dict[str, DataFrame], options: Options = DEFAULTS, clusters: bool = True
) -> dict[str, DataFrame]:
    """The six reports on a catalog, by name."""
    spark = next(iter(catalog.values())).sparkSession
    return {
        "data_dictionary": data_dictionary(catalog, options),
        "dimensions_and_keys": key_candidates(catalog),
        "column_similarity": column_similarity(catalog, options),
        "outliers": outlier_report(catalog, options),
        "clusters": cluster_report(catalog, options)
        if clusters
        else spark.createDataFrame([(SKIPPED,)], "note string"),
        "correlation": correlation_report(catalog, options),
    }


def profile_folder(
    spark: SparkSession,
    root: str,
    out: str,
    options: Options = DEFAULTS,
    clusters: bool = True,
) -> DataFrame:
    """Profile every delimited file under root and write the reports under out."""
    catalog, loaded = load_folder(spark, root, options=options)
    if not catalog:
        return loaded
    return write_reports({"load_report": loaded, **profile(catalog, options, clusters)}, out)


def describe_folder(
    spark: SparkSession,
    root: str,
    order_by: dict[str, list[str] | None] | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Describe every delimited file under root; lines with surplus fields are skipped.

    First rows and outlier examples follow the given columns, by default the lines.
    """
    catalog, _ = load_folder(spark, root, bad_lines="skip", options=options)
    order = {name: (order_by or {}).get(name) for name in catalog}
    return describe_tables(catalog, order, options)
