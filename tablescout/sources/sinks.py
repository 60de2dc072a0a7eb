"""Writing named reports together."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.sources.listing import local_path


def write_reports(reports: dict[str, DataFrame], out: str, file_format: str = "parquet") -> DataFrame:
    """One directory per report under out; returns (report, path) of what was written."""
    spark = next(iter(reports.values())).sparkSession
    written = []
    for name, report in reports.items():
        path = f"{out.rstrip('/')}/{name}"
        writer = report.write.mode("overwrite").format(file_format)
        if file_format == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(path)
        written.append((name, path))
    return spark.createDataFrame(written, "report string, path string")


def write_files(files: DataFrame, root: str, path_col: str = "path", text_col: str = "text") -> int:
    """Every row as a file of its own below root, a path that all tasks reach; returns their number.

    Null text is an empty file. Files are written under another name and renamed, so that a
    task that runs twice leaves whole files.
    """
    below = local_path(root)
    if below is None:
        raise ValueError(f"tasks cannot open {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = os.path.join(below, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with tempfile.NamedTemporaryFile("wb", dir=os.path.dirname(target), delete=False) as out:
                    out.write((text or "").encode())
                os.replace(out.name, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select(F.col(path_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
