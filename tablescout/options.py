"""Constants of the reports, gathered in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Settings shared by the reports; the defaults are the documented ones."""

    # fixed values: similarity report
    similarity_sample: int = 500
    similarity_threshold: float = 30.0
    name_weight: float = 0.4
    value_weight: float = 0.6

    # fixed values: cluster report
    max_clusters: int = 6

    # fixed values: previews
    first_rows: int = 4
    preview_rows: int = 10
    preview_columns: int = 12
    sql_rows: int = 10
    sql_files: int = 5

    # Above this many rows the value sample is thinned by hash before its shuffle.
    sample_prefilter_rows: int = 2_000_000
    # Aggregates per job, so that generated code stays compilable on wide tables.
    aggregates_per_job: int = 400


DEFAULTS = Options()
