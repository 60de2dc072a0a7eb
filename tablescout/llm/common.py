"""Column expressions and small helpers that the operators share."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.session import scratch_path

# the white space between words: \x20 and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, keeps pruning."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they wait for the driver's garbage collection.

    For steps that write what they need later. A query that runs again makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES where it is larger.

    Texts go to Python in batches; a task holds some copies of one, on both sides.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    now = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(limit, "64m").lower())
    size = int(now[1]) << units[now[2] or "b"] if now and int(now[1]) > 0 else None
    if size is None or size > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def text_of(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_list(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as ''."""
    return (F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) % folds).cast("int")


def python_fold(value: object, folds: int) -> int:
    """The same fold outside Spark."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % folds


def check_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    """Fail early, with the missing names, where a needed column is absent."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def broadcast_if_small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint where the counted rows stay under the bound, else df as it is."""
    return F.broadcast(df) if rows <= most else df


def ship(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object together with its classes, which the executors need not have."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def arrived(shared: Broadcast) -> object:
    return pickle.loads(shared.value)
