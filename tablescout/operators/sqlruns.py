"""Runs of SQL files on Spark: batches, captured rows, errors and status."""

from __future__ import annotations

import itertools
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions import paths
from tablescout.functions.text import strip
from tablescout.operators.numbering import number_rows
from tablescout.operators.preview import format_cells
from tablescout.options import DEFAULTS
from tablescout.session import scratch_path

# fixed values: a separator line is GO, optionally with a count and a comment
GO_LINE = r"(?imd)^\s*GO\s*(?:\d+)?\s*(?:--.*)?$"

EMPTY, SUCCESS, WITH_ERRORS, FAILED = "EMPTY", "SUCCESS", "COMPLETED WITH ERRORS", "FAILED"


def sql_batches(scripts: DataFrame) -> DataFrame:
    """(path, batch_no, code) of (path, text); blank batches are left out.

    The count behind GO is read over: a batch is listed once.
    """
    pieces = F.transform(F.split("text", GO_LINE, -1), strip)
    batches = F.filter(pieces, lambda b: b != "")
    return scripts.select("path", F.posexplode(batches).alias("at", "code")).select(
        "path", (F.col("at") + 1).alias("batch_no"), "code"
    )


def folder_breaks(files: DataFrame) -> DataFrame:
    """(path, folder, file_name, new_folder) of (path), marking where a folder begins.

    The report order is case-insensitive by folder and file. Rows are numbered in that
    order and meet the row before by number, so that a folder of any size is spread.
    """
    parts = files.select(
        "path",
        paths.folder(F.col("path")).alias("folder"),
        paths.file_name(F.col("path")).alias("file_name"),
    )
    keyed = parts.withColumns({"_folder": F.lower("folder"), "_file": F.lower("file_name")})
    numbered = number_rows(keyed, ["_folder", "_file", "path"])
    before = numbered.select((F.col("row_no") + 1).alias("row_no"), F.col("folder").alias("_before"))
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("folder"))
    return numbered.join(before, "row_no", "left").select(
        "path", "folder", "file_name", changed.alias("new_folder")
    )


def row_limit(wanted: object) -> int:
    """A positive whole number, or the default for anything else."""
    try:
        number = int(str(wanted).strip())
    except ValueError:
        return DEFAULTS.sql_rows
    return number if number > 0 else DEFAULTS.sql_rows


@dataclass(frozen=True)
class SqlRun:
    """Result of a run as flat tables."""

    files: DataFrame  # path, folder, file_name, status, error, seconds
    batches: DataFrame  # path, batch_no, code, result_sets, error
    rows: DataFrame  # path, batch_no, result_set_no, row_no, columns, cells, truncated


FILES = (
    "path string, folder string, file_name string, status string, error string, seconds double"
)
BATCHES = "path string, batch_no int, code string, result_sets int, error string"
ROWS = (
    "path string, batch_no int, result_set_no int, row_no int, columns array<string>, "
    "cells array<string>, truncated boolean"
)


# a semicolon outside of quotes and comments ends a statement
MARKS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;""", re.S)
COMMENT = re.compile(r"\s*(?:(?:--[^\n]*(?:\n|$)|/\*.*?\*/)\s*)*", re.S)


def statements(code: str) -> list[str]:
    """The statements of a batch; pieces of white space and comments only are left out."""
    cuts = [-1, *(m.start() for m in MARKS.finditer(code) if m[0] == ";"), len(code)]
    pieces = [code[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p for p in pieces if not COMMENT.fullmatch(p)]


class _Store:
    """A folder that the jobs of a run write their first rows to, one part per result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, scratch_path(spark, "sql-rows")
        self.parts = itertools.count()
        self.filled = False

    def add(self, result: DataFrame, key: tuple[str, int, int], limit: int) -> None:
        """Write the first rows of a result, and one more that tells whether it goes on."""
        path, batch_no, set_no = key
        names = result.columns
        first = format_cells(result.toDF(*[f"c{i}" for i in range(len(names))])).limit(limit + 1)
        # one partition in the order of the result; Spark leaves the limit out of results that it knows to be smaller
        first.coalesce(1).select(
            F.lit(path).alias("path"),
            F.lit(batch_no).alias("batch_no"),
            F.lit(set_no).alias("result_set_no"),
            (F.monotonically_increasing_id() + 1).cast("int").alias("row_no"),
            F.array(*[F.lit(n) for n in names]).alias("columns"),
            F.array(*first.columns).alias("cells"),
        ).write.parquet(f"{self.root}/part-{next(self.parts)}")
        self.filled = True

    def rows(self, limit: int) -> DataFrame:
        if not self.filled:
            return self.spark.createDataFrame([], ROWS)
        kept = self.spark.read.schema(ROWS.rsplit(",", 1)[0]).parquet(f"{self.root}/part-*")
        # at most limit + 1 rows of a result
        result = Window.partitionBy("path", "batch_no", "result_set_no")
        return kept.withColumn("truncated", F.max("row_no").over(result) > limit).where(F.col("row_no") <= limit)


@contextmanager
def _stopped_after(session: SparkSession, seconds: float | None) -> Iterator[threading.Event]:
    """Tag the jobs of this thread; after the given time they are cancelled, also later ones."""
    context, tag = session.sparkContext, f"batch-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
        while not done.wait(0.2):
            context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True) if seconds is not None else None
    context.addJobTag(tag)
    try:
        if watcher:
            watcher.start()
        yield late
    finally:
        done.set()
        if watcher:
            watcher.join()
        context.removeJobTag(tag)


def _summary(problem: Exception) -> str:
    return str(problem).split("\n\nJVM stacktrace")[0].strip()


def _run_batch(
    session: SparkSession, key: tuple[str, int], code: str, limit: int, store: _Store, seconds: float | None
) -> tuple[int, str | None]:
    """How many result sets there were, and the problem of the statement that failed, if any."""
    result_sets = 0
    with _stopped_after(session, seconds) as late:
        try:
            for statement in statements(code):
                if late.is_set():
                    break
                result = session.sql(statement)
                if result.columns:
                    store.add(result, (*key, result_sets + 1), limit)
                    result_sets += 1
        except Exception as e:  # noqa: BLE001 - kept with the batch
            if not late.is_set():
                return result_sets, _summary(e)
        return result_sets, f"stopped after {seconds:g} s" if late.is_set() else None


def _run_file(
    spark: SparkSession,
    script: Row,
    limit: int,
    prepare: Callable[[SparkSession], None] | None,
    store: _Store,
    seconds: float | None,
) -> tuple[tuple, list]:
    """The file's row and its batches."""
    path, started = script["path"], time.monotonic()
    status, error, batches = EMPTY, None, []
    # with a fair scheduler, files share the cluster evenly
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sql-{path}")
    if script["batches"]:
        try:
            session = spark
            if prepare is not None:
                session = spark.newSession()
                zone = "spark.sql.session.timeZone"
                session.conf.set(zone, spark.conf.get(zone))
                prepare(session)
            problems = []
            for no, code in script["batches"]:
                result_sets, problem = _run_batch(session, (path, no), code, limit, store, seconds)
                batches.append((path, no, code, result_sets, problem))
                if problem is not None:
                    problems.append(f"Batch {no}: {problem}")
            status = WITH_ERRORS if problems else SUCCESS
            error = "\n".join(problems) or None
        except Exception as e:  # noqa: BLE001 - outside any batch: the file failed
            status, error = FAILED, _summary(e)
    spent = time.monotonic() - started
    return (path, script["folder"], script["file_name"], status, error, spent), batches


def run_sql_files(
    spark: SparkSession,
    scripts: DataFrame,
    max_rows: object = DEFAULTS.sql_rows,
    prepare: Callable[[SparkSession], None] | None = None,
    at_once: int = DEFAULTS.sql_files,
    batch_seconds: float | None = None,
) -> SqlRun:
    """Run every batch of every script (path, text), capturing the first rows.

    A batch is one or more statements; the first that fails ends its batch. The error is
    kept and the next batch runs. With prepare, each file gets a session of its own, set up
    by prepare, so temporary views of one file do not reach another, and several files run
    at once, each in a scheduler pool of its own. The first rows of a result are written to
    the shared folder by its own job; the driver keeps codes, statuses and errors only.

    A batch that takes longer than batch_seconds has its jobs cancelled by their tag; it is
    reported as stopped, with the results it had finished, and the next one runs.
    """
    limit = row_limit(max_rows)
    split = (
        scripts.select(
            "path",
            paths.folder(F.col("path")).alias("folder"),
            paths.file_name(F.col("path")).alias("file_name"),
        )
        .join(
            sql_batches(scripts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("batch_no", "code"))).alias("batches")),
            "path",
            "left",
        )
        .orderBy(F.lower("folder"), F.lower("file_name"), "path")
    )
    store = _Store(spark)
    with ThreadPoolExecutor(at_once if prepare is not None else 1) as pool:
        work: Iterable[Row] = split.toLocalIterator()
        ran = list(pool.map(lambda script: _run_file(spark, script, limit, prepare, store, batch_seconds), work))
    return SqlRun(
        spark.createDataFrame([f for f, _ in ran], FILES),
        spark.createDataFrame([b for _, batches in ran for b in batches], BATCHES),
        store.rows(limit),
    )


def run_summary(files: DataFrame) -> DataFrame:
    """One row: how many files there are and how they ended."""
    status = F.col("status")
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(status == SUCCESS).alias("successful"),
        F.count_if(status.isin(FAILED, WITH_ERRORS)).alias("failed_or_errors"),
        F.count_if(status == EMPTY).alias("empty_files"),
    )
