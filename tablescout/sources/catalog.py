"""A catalog: table name to lazy DataFrame, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from tablescout.operators.columns import union_all
from tablescout.operators.quantiles import row_counts
from tablescout.options import DEFAULTS, Options
from tablescout.sources.files import (
    DATA_SUFFIXES,
    FileTraits,
    cast_text,
    cell_forms,
    file_cells,
    file_manifest,
    file_traits,
    fitting_type,
    header_names,
    missing_tokens_to_null,
    plain_path,
    read_text_table,
    skip_bad_lines,
    unique_names,
    whole_records,
)

LOADED = "loaded"
REPORT = "table_no int, table_name string, path string, rows bigint, status string"


def parquet_catalog(spark: SparkSession, folder: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    """The named parquet tables of a folder."""
    return {t: spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables}


@dataclass
class _File:
    """A listed file and what is found out about it."""

    path: str
    stem: str
    traits: FileTraits | None = None
    names: list[str] = field(default_factory=list)
    targets: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    bad: int = 0
    problem: str | None = None


@dataclass(frozen=True)
class Family:
    """Tables of a folder with the same columns and types, whose files are read together.

    `rows` has the rows of all of them, with the path of their file in the column `path`;
    `tables` is (path, table_no, table_name, columns_before), a row per table.
    """

    rows: DataFrame
    path: str
    tables: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != self.path]

    def aggregate(self, rows: DataFrame, aggregates: list[Column]) -> DataFrame:
        """(table_no, table_name, columns_before, aggregates) of every table, from one pass over
        rows; a table without rows has NULL."""
        by_file = rows.groupBy(self.path).agg(*aggregates)
        return self.tables.join(by_file, self.path, "left").drop(self.path)


class FolderCatalog(Mapping[str, DataFrame]):
    """Table name to lazy DataFrame, made when it is asked for, and the families of all tables.

    A report that goes by families has as many plans as there are kinds of files, one that goes
    by tables has one for each file.
    """

    def __init__(self, spark: SparkSession, files: list[_File]) -> None:
        self._spark = spark
        self._files = dict(zip(unique_names(f.stem for f in files), files, strict=True))
        self._tables: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(self._files)

    def __len__(self) -> int:
        return len(self._files)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            f = self._files[name]
            self._tables[name] = _typed_text(self._spark, f.path, f)
        return self._tables[name]

    def families(self) -> list[Family]:
        """The tables by their columns and types, in the order of the first of each."""
        alike: dict[tuple, list[tuple[_File, tuple]]] = {}
        before = 0
        for no, (name, f) in enumerate(self._files.items(), start=1):
            kind = (f.traits, tuple(f.names), tuple(sorted(f.targets.items())))
            alike.setdefault(kind, []).append((f, (f.path, no, name, before)))
            before += len(f.names)
        found = []
        for members in alike.values():
            first = members[0][0]
            path = "_path"
            while path in [n.lower() for n in first.names]:
                path += "_"
            rows = _typed_text(self._spark, [f.path for f, _ in members], first, path)
            kinds = f"`{path}` string, table_no int, table_name string, columns_before int"
            tables = self._spark.createDataFrame([row for _, row in members], kinds)
            found.append(Family(rows, path, tables))
        return found


def _typed_text(spark: SparkSession, path: str | list[str], like: _File, path_as: str | None = None) -> DataFrame:
    """The rows of files that are all like one, in its types."""
    text = read_text_table(spark, path, like.traits, like.names, has_header=True, path_as=path_as)
    return cast_text(missing_tokens_to_null(skip_bad_lines(text)), like.targets)


def _isolated(files: list[_File], job: Callable[[list[_File]], None]) -> None:
    """Run one job over all files; where it fails, halve them until the failing ones are found."""
    try:
        if files:
            job(files)
    except Exception as problem:  # noqa: BLE001 - kept apart, the other files go on
        if len(files) == 1:
            files[0].problem = str(problem).strip().split("\n")[0]
            return
        half = len(files) // 2
        _isolated(files[:half], job)
        _isolated(files[half:], job)


def _find_traits(spark: SparkSession, files: list[_File]) -> None:
    """Encoding, separator, quotes and header of all files, from one scan."""
    by_path = {f.path: f for f in files}
    for row in file_traits(spark, list(by_path)).collect():  # one row per file
        found = by_path[row["path"]]
        if row["header"] is not None:
            found.traits = FileTraits(row["encoding"], row["separator"], row["open_quotes"])
            found.names = header_names(row["header"], row["separator"])


def _find_types(spark: SparkSession, files: list[_File]) -> None:
    """Types, rows and bad lines of all files, from one scan; files of one kind are read together."""
    by_path = {f.path: f for f in files}
    kinds: dict[FileTraits, list[_File]] = {}
    for f in files:
        kinds.setdefault(f.traits, []).append(f)
    cells = []
    for traits, own in kinds.items():
        if traits.open_quotes:  # the header may span lines as well: one row per file
            headers = whole_records(spark, [f.path for f in own], traits).where("is_header")
            for row in headers.select(plain_path("file").alias("path"), "record").collect():
                by_path[row["path"]].names = header_names(row["record"], traits.separator)
        width = max(len(f.names) for f in own) + 1
        cells.append(file_cells(spark, [f.path for f in own], traits, width))
    widths = spark.createDataFrame([(f.path, len(f.names)) for f in files], "path string, width int")
    for f in files:
        f.rows = f.bad = 0
    for row in cell_forms(union_all(cells), widths).collect():  # one row per file and column
        found = by_path[row["path"]]
        found.rows, found.bad = row["n_rows"], row["n_bad"]
        target = fitting_type(row["n"], row.asDict())
        if target:
            found.targets[found.names[row["column_no"]]] = target


def load_folder(
    spark: SparkSession,
    root: str,
    suffixes: Iterable[str] = DATA_SUFFIXES,
    bad_lines: str = "error",
    options: Options = DEFAULTS,  # noqa: ARG001
) -> tuple[FolderCatalog, DataFrame]:
    """Every delimited file under root as a table, and a report of what was loaded.

    A file that cannot be read is reported and skipped. One scan finds the encodings,
    separators and headers of all files, one more all types, rows and bad lines: the number
    of jobs does not depend on the number of files. What the driver holds is a row per file
    and column; a table's DataFrame is made when it is asked for.
    """
    if bad_lines not in ("error", "skip"):
        raise ValueError(f"unknown rule for bad lines: {bad_lines}")
    # the listing: one row per file
    listed = file_manifest(spark, root, suffixes).select("path", "stem", "file_name", "length").collect()
    found = [_File(row["path"], row["stem"]) for row in listed]
    for f, row in zip(found, listed, strict=True):
        if row["length"] == 0:
            f.problem = "no lines to read"
        elif row["file_name"].startswith(("_", ".")):
            f.problem = "Spark does not read files with hidden names"
    _isolated([f for f in found if not f.problem], lambda part: _find_traits(spark, part))
    for f in found:
        if not f.problem and not f.names:
            f.problem = "no lines to read"
    _isolated([f for f in found if not f.problem], lambda part: _find_types(spark, part))
    for f in found:
        if not f.problem and f.bad and bad_lines == "error":
            f.problem = f"{f.bad} lines have more fields than the header"
    good = [f for f in found if not f.problem]
    catalog = FolderCatalog(spark, good)
    rows = [(no, name, f.path, f.rows, LOADED) for no, (name, f) in enumerate(zip(catalog, good, strict=True), start=1)]
    rows += [(None, None, f.path, None, f"skipped: {f.problem}") for f in found if f.problem]
    return catalog, spark.createDataFrame(rows, REPORT)


def load_report(spark: SparkSession, folder: str, tables: Iterable[str]) -> DataFrame:
    """(table_no, table_name, path, rows, status) of parquet tables."""
    found: dict[str, DataFrame] = {}
    status = {}
    listed = [(no, t, f"{folder.rstrip('/')}/{t}.parquet") for no, t in enumerate(tables, start=1)]
    for _, table, path in listed:
        try:
            found[table] = spark.read.parquet(path)
            status[table] = LOADED
        except Exception as problem:  # noqa: BLE001 - reported, the other tables go on
            status[table] = f"skipped: {str(problem).splitlines()[0]}"
    counts = row_counts(found) if found else {}
    rows = [(no, t, path, counts.get(t), status[t]) for no, t, path in listed]
    return spark.createDataFrame(rows, REPORT)
