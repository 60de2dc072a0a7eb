"""Complete listings of a folder: hidden names and files without a byte included.

Spark's own listings leave both out. Folders that tasks can reach as paths are listed by a
Python data source, folder by folder in parallel tasks; other stores by the driver through
Hadoop's file system, which is the only one that knows them.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# the workers need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOURCE = "folder_listing"
LISTED = "path string, length bigint, modified double"
# the driver opens folders until there are so many to hand out
FOLDERS = 64
BATCH_ROWS = 10_000


def local_path(root: str) -> str | None:
    """The path that tasks can open, or None for a store of another scheme."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", root)
    if scheme and scheme[1].lower() != "file":
        return None
    return re.sub(r"^file:/+", "/", root)


def _open(folder: str) -> tuple[list[str], list[tuple[str, int, float]]]:
    """Folders and files directly inside a folder; links to folders are not followed."""
    folders, files = [], []
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.path)
            elif entry.is_file():
                known = entry.stat()
                files.append((entry.path, known.st_size, known.st_mtime))
    return folders, files


class _Share(InputPartition):
    """Folders whose whole trees a task lists, and files that are listed already."""

    def __init__(self, folders: list[str], files: list[tuple[str, int, float]]):
        self.folders = folders
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, shares: int):
        self.root = root
        self.shares = shares

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            known = os.stat(self.root)
            return [_Share([], [(self.root, known.st_size, known.st_mtime)])]
        folders, files = [self.root], []
        # breadth first, so that one deep tree is shared out as well
        while folders and len(folders) < self.shares:
            inner = []
            for folder in folders:
                below, own = _open(folder)
                inner += below
                files += own
            folders = inner
        step = max(1, -(-len(folders) // self.shares))
        shares = [_Share(folders[i : i + step], []) for i in range(0, len(folders), step)]
        return [_Share([], files), *shares]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        rows = list(partition.files)
        todo = list(partition.folders)
        while todo or rows:
            while todo and len(rows) < BATCH_ROWS:
                below, own = _open(todo.pop())
                todo += below
                rows += own
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "length", "modified"])
            rows = []


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(self.options["root"], int(self.options.get("shares", FOLDERS)))


def _store_listing(spark: SparkSession, root: str) -> DataFrame:
    """The listing of a store that only Hadoop's file system reaches; made on the driver."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    rows = []
    while files.hasNext():
        f = files.next()
        rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime() / 1000))
    return spark.createDataFrame(rows, LISTED)


def list_files(spark: SparkSession, root: str, shares: int = FOLDERS) -> DataFrame:
    """(path, length, modified in seconds) of every file below root, in no order.

    A root that does not exist is an error, an empty one gives no rows.
    """
    local = local_path(root)
    if local is None:
        return _store_listing(spark, root)
    if not os.path.exists(local):
        raise FileNotFoundError(local)
    spark.dataSource.register(FolderListing)
    return spark.read.format(SOURCE).option("root", local.rstrip("/") or "/").option("shares", shares).load()
