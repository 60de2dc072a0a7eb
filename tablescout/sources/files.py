"""Finding files, naming tables, reading text and delimited files."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import paths, sqltext
from tablescout.functions.text import INTEGER_TEXT, NUMBER_TEXT, null_if_missing, strip
from tablescout.operators.columns import chunks, col
from tablescout.operators.numbering import number_rows
from tablescout.options import DEFAULTS, Options
from tablescout.sources.listing import list_files
from tablescout.sources.records import ends_inside, file_lines, judged_lines, quote_pieces, records

# fixed values: what each listing looks for
DATA_SUFFIXES = (".csv", ".tsv", ".txt")
SQL_SUFFIXES = (".sql",)
SCRIPT_SUFFIXES = (".py",)
LOCK_PREFIX = "~$"

# fixed values: encodings in the order they are tried
ENCODINGS = ("utf-8", "cp1252", "latin-1")
UNDEFINED_IN_CP1252 = "81|8D|8F|90|9D"

# fixed values: separators a .txt file may use, in order of preference
SEPARATORS = (",", "\t", "|", ";", " ")

SURPLUS = "_surplus"

# fixed values: texts that read as a boolean
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
# the first type whose form all values have; whole numbers of over 38 digits stay text
FORMS = {"int": "bigint", "dec": "decimal(38,0)", "whole": None, "num": "double", "bool": "boolean"}


# ---- discovery -----------------------------------------------------------------


def plain_path(path: Column | str) -> Column:
    """Path without scheme, URL escapes undone."""
    path = F.col(path) if isinstance(path, str) else path
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^[a-z0-9]+:/+", "/")


def _relative(path: Column, root: str) -> Column:
    base = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def _glob(suffixes: Iterable[str]) -> str:
    """A file name pattern for some suffixes in either case, for the listing itself."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*{" + ",".join(map(either, suffixes)) + "}"


def file_manifest(
    spark: SparkSession,
    root: str,
    suffixes: Iterable[str] = DATA_SUFFIXES,
    skip_locks: bool = True,
    skip_names: Iterable[str] = (),
) -> DataFrame:
    """(path, relative_path, folder, file_name, stem, suffix, length) in path order.

    Only the listing is used, file contents are never read. Hidden names and files without a
    byte are listed too; Spark's readers skip both.
    """
    suffixes = list(suffixes)
    listed = list_files(spark, root).select(
        F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("path"), "length"
    )
    relative = _relative(F.col("path"), root)
    found = listed.select(
        "path",
        relative.alias("relative_path"),
        paths.folder(relative).alias("folder"),
        paths.file_name(relative).alias("file_name"),
        paths.stem(relative).alias("stem"),
        paths.suffix(relative).alias("suffix"),
        "length",
    ).where(F.col("suffix").isin(*suffixes))
    if skip_locks:
        found = found.where(~F.col("file_name").startswith(LOCK_PREFIX))
    if skip_names:
        found = found.where(~F.col("file_name").isin(*skip_names))
    return found.orderBy("path")


# ---- table names ---------------------------------------------------------------


def unique_names(stems: Iterable[str]) -> list[str]:
    """``a, a, a`` becomes ``a, a (2), a (3)``; a name that is taken is passed over."""
    taken: set[str] = set()
    last: dict[str, int] = {}  # the last number that a stem was given
    names = []
    for stem in stems:
        n = last.get(stem, 1)
        name = stem if n == 1 else f"{stem} ({n})"
        while name in taken:
            n += 1
            name = f"{stem} ({n})"
        last[stem] = n
        taken.add(name)
        names.append(name)
    return names


def table_names(files: DataFrame, order_by: str = "path", base: str = "stem") -> DataFrame:
    """Add table_name: the base name, numbered from its second use in path order.

    For listings of any length. A base that itself looks like ``x (2)`` needs
    unique_names, which sees the names given so far.
    """
    numbered = number_rows(files, [order_by], within=[base], name="_use")
    return numbered.withColumn(
        "table_name",
        F.when(F.col("_use") == 1, col(base)).otherwise(
            F.concat(col(base), F.lit(" ("), F.col("_use").cast("string"), F.lit(")"))
        ),
    ).drop("_use")


# ---- encodings and separators --------------------------------------------------


def sniff_separator(line: Column) -> Column:
    """The candidate that occurs most often in a header line; tab if there is none.

    A space only counts when no other candidate occurs.
    """
    best = F.lit("\t")
    most = F.lit(0)
    for separator in SEPARATORS[:-1]:
        uses = F.length(line) - F.length(F.replace(line, F.lit(separator), F.lit("")))
        best = F.when(uses > most, F.lit(separator)).otherwise(best)
        most = F.greatest(most, uses)
    space = SEPARATORS[-1]
    return F.when(most > 0, best).when(F.contains(line, F.lit(space)), F.lit(space)).otherwise(best)


def file_traits(
    spark: SparkSession, files: str | list[str], encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """(path, encoding, open_quotes, header, separator), one row per file with a line.

    Judged line by line, so that large files are split over tasks: the first of the given
    encodings (utf-8, cp1252, latin-1) that every line allows, whether some line may end inside
    a quoted field, and the first line that is not blank with its separator. A quote inside a
    field, like an inch mark, opens nothing.
    """
    line = F.col("value")
    whole = F.is_valid_utf8(line)
    undefined = F.hex(line.cast("binary")).rlike(f"^(?:..)*(?:{UNDEFINED_IN_CP1252})")
    # lines keep their order within a split, and the first split starts at byte 0
    first = (F.col("_metadata.file_block_start") == 0) & (F.trim(line) != "")
    place = F.when(first, F.monotonically_increasing_id())
    opens = [
        F.bool_or(F.contains(line, F.lit('"')) & ends_inside(F.col("pieces"), s)).alias(f"opens_{i}")
        for i, s in enumerate(SEPARATORS)
    ]
    judged = (
        spark.read.option("recursiveFileLookup", True)
        .text(files)
        .select("value", "_metadata", place.alias("place"), quote_pieces(line).alias("pieces"))
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(
            F.bool_and(whole).alias("utf8"),
            F.bool_or(~whole & undefined).alias("undefined"),
            *opens,
            F.min_by(line.cast("binary"), "place").alias("bytes"),
        )
    )
    allowed = dict(zip(ENCODINGS, (F.col("utf8"), ~F.col("undefined"), F.lit(True)), strict=True))
    unknown = [e for e in encodings if e not in allowed]
    if unknown or not encodings:
        raise ValueError(f"encodings must be some of {', '.join(ENCODINGS)}")
    encoding = F.coalesce(*[F.when(allowed[e], F.lit(e)) for e in encodings])
    judged = judged.select("*", plain_path(F.col("file")).alias("path"), encoding.alias("encoding"))
    utf8, latin = F.make_valid_utf8(F.col("bytes").cast("string")), F.decode("bytes", "ISO-8859-1")
    header = (
        F.when(F.col("encoding") == "latin-1", latin)
        .when(F.col("encoding") == "cp1252", _cp1252_from_latin1(latin))
        .otherwise(utf8)
    )
    kind = F.lower("path")
    judged = judged.withColumn("header", header)
    judged = judged.withColumn(
        "separator",
        F.when(kind.endswith(".csv"), F.lit(","))
        .when(kind.endswith(".tsv"), F.lit("\t"))
        .otherwise(sniff_separator(F.col("header"))),
    )
    found = F.coalesce(*[F.when(F.col("separator") == s, F.col(f"opens_{i}")) for i, s in enumerate(SEPARATORS)])
    return judged.select("path", "encoding", found.alias("open_quotes"), "header", "separator")


def separator_of(spark: SparkSession, path: str) -> str:
    """Comma for .csv, tab for .tsv, otherwise judged by the first line."""
    lowered = path.lower()
    if lowered.endswith((".csv", ".tsv")):
        return "," if lowered.endswith(".csv") else "\t"
    header = spark.read.text(path).select(
        sniff_separator(F.make_valid_utf8(F.col("value"))).alias("separator")
    )
    return header.first()["separator"]


@dataclass(frozen=True)
class FileTraits:
    """How one file is to be read."""

    encoding: str = "utf-8"
    separator: str = ","
    open_quotes: bool = False


def _cp1252_from_latin1(c: Column) -> Column:
    """Read the C1 control characters of latin-1 as their cp1252 characters."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def header_names(header: str, separator: str) -> list[str]:
    """Column names of a header record; a field without text is named by its place."""
    fields = next(csv.reader([header.lstrip("\ufeff")], delimiter=separator), [])
    return unique_names(name or f"_c{i}" for i, name in enumerate(fields))


def _decoded(c: Column, encoding: str) -> Column:
    """Text from the bytes of a text file that were taken for UTF-8."""
    if encoding == "utf-8":
        return c
    latin = F.decode(c.cast("binary"), "ISO-8859-1")
    return _cp1252_from_latin1(latin) if encoding == "cp1252" else latin


def whole_records(spark: SparkSession, path: str | list[str], traits: FileTraits) -> DataFrame:
    """(file, record, is_header) of files whose quoted fields span lines; blank ones are left out."""
    found = records(judged_lines(file_lines(spark, path), traits.separator)).where(F.trim("record") != "")
    return found.select("file", _decoded(F.col("record"), traits.encoding).alias("record"), "is_header")


def _parsed(record: Column, width: int, separator: str) -> Column:
    fields = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(record, fields, {"sep": separator, "quote": '"', "escape": '"'})


def _reader(spark: SparkSession, traits: FileTraits, header: bool):
    return (
        spark.read.option("sep", traits.separator)
        .option("encoding", "UTF-8" if traits.encoding == "utf-8" else "ISO-8859-1")
        .option("quote", '"')
        .option("escape", '"')
        .option("header", header)
        .option("recursiveFileLookup", True)
    )


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    traits: FileTraits,
    names: list[str] | None = None,
    has_header: bool | None = None,
    path_as: str | None = None,
) -> DataFrame:
    """All columns as text plus SURPLUS, which is set on rows with too many fields; path_as names
    one more with the path of the row's file.

    Column names come from the first line unless they are given; has_header says whether
    there is such a line where names are given, else there is none. Short rows are filled up
    with NULL. Files are split over tasks, those with quoted fields that span lines too.
    """
    header = names is None if has_header is None else has_header
    if traits.open_quotes:
        rows = whole_records(spark, path, traits)
        if names is None:
            first = rows.where("is_header").orderBy("file").first()
            names = header_names(first["record"], traits.separator) if first else []
    elif names is None:
        names = _reader(spark, traits, header).csv(path).columns
    if not names:
        raise ValueError(f"no columns to read from {path}")
    names = unique_names(n.lstrip("\ufeff") for n in names)
    if traits.open_quotes:
        if header:
            rows = rows.where("not is_header")
        cells = rows.select("file", _parsed(F.col("record"), len(names) + 1, traits.separator).alias("cells"))
        path_column = [plain_path("file").alias(path_as)] if path_as else []
        return cells.select(
            *[F.col(f"cells.c{i}").alias(n) for i, n in enumerate([*names, SURPLUS])], *path_column
        )
    fields = [T.StructField(n, T.StringType()) for n in [*names, SURPLUS]]
    rows = _reader(spark, traits, header).schema(T.StructType(fields)).csv(path)
    path_column = [plain_path("_metadata.file_path").alias(path_as)] if path_as else []
    if traits.encoding == "cp1252":
        return rows.select(*[_cp1252_from_latin1(col(c)).alias(c) for c in rows.columns], *path_column)
    return rows.select("*", *path_column) if path_as else rows


def file_cells(spark: SparkSession, paths: list[str], traits: FileTraits, width: int) -> DataFrame:
    """(path, cells): every row below the header of some files of one kind, as width texts."""
    if traits.open_quotes:
        rows = whole_records(spark, paths, traits).where("not is_header")
        cells = F.array(*[F.col(f"cells.c{i}") for i in range(width)])
        parsed = rows.select("file", _parsed(F.col("record"), width, traits.separator).alias("cells"))
        return parsed.select(plain_path(F.col("file")).alias("path"), cells.alias("cells"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = _reader(spark, traits, True).schema(schema).csv(paths)
    cells = [_cp1252_from_latin1(F.col(c)) if traits.encoding == "cp1252" else F.col(c) for c in schema.names]
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.array(*cells).alias("cells"))


def cell_forms(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """(path, column_no, n_rows, n_bad, n, int, dec, whole, num, bool): the forms that the values of
    every column of every file have, from (path, cells) and (path, width).

    Rows with a value beyond the width of their file are bad: they are counted, their values
    are not. Counts are added up before they move.
    """
    value = null_if_missing(F.col("value"))
    beyond = F.exists(F.slice("cells", F.col("width") + 1, F.size("cells")), lambda c: c.isNotNull())
    rows = cells.join(widths, "path").withColumn("bad", beyond)
    rows = rows.select("path", "bad", F.posexplode(F.slice("cells", F.lit(1), F.col("width"))).alias("column_no", "value"))
    rows = rows.select("path", "column_no", "bad", F.when(~F.col("bad"), value).alias("value"))
    v, whole = F.col("value"), F.col("value").rlike(INTEGER_TEXT)
    return rows.groupBy("path", "column_no").agg(
        F.count_if(~F.col("bad")).alias("n_rows"),
        F.count_if("bad").alias("n_bad"),
        F.count(v).alias("n"),
        F.count_if(whole & F.trim(v).try_cast("bigint").isNotNull()).alias("int"),
        F.count_if(whole & F.trim(v).try_cast("decimal(38,0)").isNotNull()).alias("dec"),
        F.count_if(whole).alias("whole"),
        F.count_if(v.rlike(NUMBER_TEXT)).alias("num"),
        F.count_if(v.isin(*BOOLEAN_TEXTS)).alias("bool"),
    )


def fitting_type(present: int, counts: dict[str, int]) -> str | None:
    """The first type that all values have the form of; None leaves a column as text."""
    fitting = [kind for form, kind in FORMS.items() if counts[form] == present]
    return fitting[0] if present and fitting else None


def cast_text(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Text columns in the types found for them, the others as they are."""
    return df.select(
        *[strip(col(c)).try_cast(targets[c]).alias(c) if c in targets else col(c) for c in df.columns]
    )


def skip_bad_lines(rows: DataFrame) -> DataFrame:
    """Drop the rows with more fields than the header."""
    return rows.where(F.col(SURPLUS).isNull()).drop(SURPLUS)


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns become NULL."""
    return df.select(
        *[
            null_if_missing(col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def infer_types(df: DataFrame, options: Options = DEFAULTS, must_be_empty: str | None = None) -> DataFrame:
    """Cast text columns whose every value is a whole number, a number or a boolean.

    One scan counts the forms. Whole numbers are bigint while all fit, else of 38 digits,
    else they stay text. Columns without a value and dates stay text. The same scan raises an error when the column named by must_be_empty, which is dropped, has
    a value.
    """
    if must_be_empty is not None:
        checked = f"count({sqltext.name(must_be_empty)}) as surplus"
    else:
        checked = "0L as surplus"
    names = [c for c in df.columns if c != must_be_empty]
    targets: dict[str, str] = {}
    booleans = ", ".join(sqltext.text(t) for t in BOOLEAN_TEXTS)
    for group in chunks(list(enumerate(names)), options.aggregates_per_job // 6):
        aggregates = [checked]
        for i, name in group:
            q = sqltext.name(name)
            whole = f"{q} rlike {sqltext.text(INTEGER_TEXT)}"
            aggregates += [
                f"count({q}) as n_{i}",
                f"count_if({whole} and try_cast(trim({q}) as bigint) is not null) as int_{i}",
                f"count_if({whole} and try_cast(trim({q}) as decimal(38,0)) is not null) as dec_{i}",
                f"count_if({whole}) as whole_{i}",
                f"count_if({q} rlike {sqltext.text(NUMBER_TEXT)}) as num_{i}",
                f"count_if({q} in ({booleans})) as bool_{i}",
            ]
        row = df.selectExpr(*aggregates).first()
        if row["surplus"]:
            raise ValueError(f"{row['surplus']} lines have more fields than the header")
        for i, name in group:
            target = fitting_type(row[f"n_{i}"], {form: row[f"{form}_{i}"] for form in FORMS})
            if target:
                targets[name] = target
    return cast_text(df.select(*[col(c) for c in names]), targets)


def _typed(rows: DataFrame, bad_lines: str, options: Options) -> DataFrame:
    """Types and the rule for bad lines, from one scan."""
    if bad_lines == "skip":
        return infer_types(missing_tokens_to_null(skip_bad_lines(rows)), options)
    if bad_lines != "error":
        raise ValueError(f"unknown rule for bad lines: {bad_lines}")
    kept = [null_if_missing(col(c)).alias(c) for c in rows.columns if c != SURPLUS]
    return infer_types(rows.select(*kept, SURPLUS), options, must_be_empty=SURPLUS)


def read_delimited(
    spark: SparkSession,
    path: str,
    traits: FileTraits,
    bad_lines: str = "error",
    options: Options = DEFAULTS,
) -> DataFrame:
    """One delimited file as a typed table; bad_lines is ``error`` or ``skip``."""
    rows = read_text_table(spark, path, traits)
    return _typed(rows, bad_lines, options)


def read_table_folder(
    spark: SparkSession,
    folder: str,
    bad_lines: str = "error",
    options: Options = DEFAULTS,
    encodings: Sequence[str] = ENCODINGS,
) -> DataFrame:
    """One table written as many files; files of one kind are read together.

    Every file has its own header line: columns meet by name, and those that a file lacks
    are NULL in its rows.
    """
    kinds = file_traits(spark, folder, encodings).groupBy("encoding", "open_quotes", "separator", "header").agg(
        F.sort_array(F.collect_list("path")).alias("paths")
    )
    table = None
    for row in kinds.collect():  # the listing: one path per file
        if row["encoding"] is None:
            raise ValueError(f"no encoding of {', '.join(encodings)} fits {row['paths'][0]}")
        traits = FileTraits(row["encoding"], row["separator"], row["open_quotes"])
        part = read_text_table(spark, row["paths"], traits)
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    if table is None:
        raise ValueError(f"no file with a line in {folder}")
    return _typed(table.select(*[c for c in table.columns if c != SURPLUS], SURPLUS), bad_lines, options)


# ---- whole texts ---------------------------------------------------------------


def text_catalog(
    spark: SparkSession,
    root: str,
    suffixes: Iterable[str],
    errors: str = "replace",
) -> DataFrame:
    """(path, text): every file as one text, without byte-order mark.

    Bytes that are not UTF-8 become U+FFFD, or vanish with ``errors="ignore"``. Line
    ends are read as a line feed.
    """
    suffixes = list(suffixes)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(suffixes))
        .load(root)
        .select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("path"), "content")
        .where(paths.suffix(F.col("path")).isin(*suffixes))
    )
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if errors == "ignore":
        text = F.replace(text, F.lit("\ufffd"), F.lit(""))
    elif errors != "replace":
        raise ValueError(f"unknown rule for undecodable bytes: {errors}")
    text = F.regexp_replace(text, "^\ufeff", "")
    return files.select("path", F.regexp_replace(text, r"\r\n?", "\n").alias("text"))


def text_lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, text)."""
    lines = F.split(F.regexp_replace("text", r"\n$", ""), r"\r?\n", -1)
    return texts.select("path", F.posexplode(lines).alias("at", "line")).select(
        "path", (F.col("at") + 1).alias("line_no"), "line"
    )
