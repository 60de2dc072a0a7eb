"""Column classes of a table and the counts of its values.

Values are counted in five typed families: integers in ``l``, floats in ``d``, decimals in
``m``, dates and timestamps in ``t``, everything else as text in ``s``. Grouping the typed values
spares the number-to-text conversion of every cell. Decimals differ in precision and scale from
column to column; they are counted as texts that sort like the numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import sqltext
from tablescout.functions.text import display_number

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

FAMILIES = {"l": "bigint", "d": "double", "m": "string", "s": "string", "t": "timestamp_ntz"}
CELL = tuple(FAMILIES)

# digits of a decimal with its point, for texts of one length
DECIMAL_PLACES = 40
DIGITS, MIRRORED = "0123456789", "9876543210"

Fields = list[tuple[int, T.StructField]]


def col(name: str) -> Column:
    return F.col(sqltext.name(name))


def as_double(name: str) -> str:
    return f"double({sqltext.name(name)})"


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that later steps know one kind of missing value."""
    if not any(isinstance(f.dataType, FLOAT_TYPES) for f in df.schema.fields):
        return df
    cleaned = []
    for f in df.schema.fields:
        q = sqltext.name(f.name)
        is_float = isinstance(f.dataType, FLOAT_TYPES)
        cleaned.append(f"nanvl({q}, cast(null as {f.dataType.simpleString()})) as {q}" if is_float else q)
    return df.selectExpr(*cleaned)


def flat_fields(df: DataFrame) -> Fields:
    """(column number, field) of all columns that hold single values."""
    return [
        (no, f)
        for no, f in enumerate(df.schema.fields, start=1)
        if not isinstance(f.dataType, NESTED_TYPES)
    ]


def numeric_fields(df: DataFrame) -> Fields:
    return [(no, f) for no, f in flat_fields(df) if isinstance(f.dataType, T.NumericType)]


def stack_rows(df: DataFrame, rows: Iterable[Sequence[object]], names: Sequence[str]) -> DataFrame:
    """Several output rows per input row; the cells are SQL text."""
    rows = list(rows)
    cells = ", ".join(str(cell) for row in rows for cell in row)
    return df.selectExpr(f"stack({len(rows)}, {cells}) as ({', '.join(names)})")


def _family(field: T.StructField) -> tuple[str, str]:
    """Family of a column and its value in that family as SQL text."""
    q = sqltext.name(field.name)
    kind = field.dataType
    if isinstance(kind, INTEGER_TYPES):
        return "l", f"bigint({q})"
    if isinstance(kind, FLOAT_TYPES):
        return "d", f"double({q})"
    if isinstance(kind, T.DecimalType):
        digits = f"lpad(string(abs({q})), {DECIMAL_PLACES}, '0')"
        below = f"concat('-', translate({digits}, '{DIGITS}', '{MIRRORED}'))"
        return "m", f"if({q} < 0, {below}, concat('0', {digits}))"
    if isinstance(kind, TIME_TYPES):
        return "t", f"cast({q} as timestamp_ntz)"
    if isinstance(kind, T.BinaryType):
        return "s", f"make_valid_utf8(string({q}))"
    return "s", f"string({q})"


def value_counts(df: DataFrame) -> DataFrame:
    """(column_no, l, d, s, t, n): how often each value occurs in each column.

    One narrow scan per family, which reads only the family's columns. Repeated values
    collapse before the shuffle, so a value that fills a third of a column reaches the
    reducers as one row per task.
    """
    cleaned = missing_to_null(df)
    members: dict[str, list[tuple[int, str]]] = {}
    for no, f in flat_fields(df):
        family, value = _family(f)
        members.setdefault(family, []).append((no, value))
    parts = []
    for family, rows in members.items():
        counted = (
            stack_rows(cleaned, rows, ["column_no", family])
            .groupBy("column_no", family)
            .agg(F.count(F.lit(1)).alias("n"))
        )
        others = [f"cast(null as {t}) as {c}" for c, t in FAMILIES.items() if c != family]
        parts.append(counted.selectExpr("column_no", family, *others, "n"))
    return union_all(parts).select("column_no", *CELL, "n")


def is_present() -> Column:
    """True for a counted value that is not missing."""
    return F.expr(" or ".join(f"{c} is not null" for c in CELL))


def cell_order() -> list[Column]:
    """Sort keys by the typed value; one of them is set within a column."""
    return [F.col(c) for c in CELL]


def cell_text(fields: Fields) -> Column:
    """Display text of a counted value."""
    dates = [no for no, f in fields if isinstance(f.dataType, T.DateType)]
    as_time = F.col("t").cast("string")
    if dates:
        as_date = F.col("t").cast("date").cast("string")
        as_time = F.when(F.col("column_no").isin(*dates), as_date).otherwise(as_time)
    return F.coalesce(
        F.col("s"), F.col("l").cast("string"), display_number(F.col("d")), _decimal_text(F.col("m")), as_time
    )


def _decimal_text(sortable: Column) -> Column:
    """The decimal that a sortable text stands for; '-' sorts before '0'."""
    below = F.startswith(sortable, F.lit("-"))
    digits = F.substring(sortable, 2, DECIMAL_PLACES)
    digits = F.when(below, F.translate(digits, MIRRORED, DIGITS)).otherwise(digits)
    bare = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(below, F.concat(F.lit("-"), bare)).otherwise(bare)


def failing_columns(df: DataFrame) -> dict[int, str]:
    """{column number: problem} of the flat columns that cannot be evaluated on every row.

    One scan that only hashes the values; where it fails, the columns are halved until the
    failing ones are found, so a table without any costs one scan.
    """

    def problem_of(fields: Fields) -> str | None:
        hashed = F.bit_xor(F.xxhash64(*[col(f.name) for _, f in fields]))
        try:
            df.agg(hashed.alias("h")).collect()
        except PySparkException as e:
            return e.getCondition() or str(e).strip().split("\n")[0]
        return None

    found = {}
    open_groups = [flat_fields(df)]
    while open_groups:
        group = open_groups.pop()
        problem = problem_of(group) if group else None
        if problem is None:
            continue
        if len(group) == 1:
            found[group[0][0]] = problem
        else:
            half = len(group) // 2
            open_groups += [group[:half], group[half:]]
    return found


def column_names(df: DataFrame) -> DataFrame:
    """(column_no, column_name) of the flat columns, from the schema."""
    rows = [(no, f.name) for no, f in flat_fields(df)]
    return df.sparkSession.createDataFrame(rows, "column_no int, column_name string")


def with_order(df: DataFrame, order_by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Add sort keys _k0, _k1 ..; without columns to order by, rows go as they are read."""
    if order_by is None:
        return df.withColumn("_k0", F.monotonically_increasing_id()), ["_k0"]
    keys = [f"_k{i}" for i in range(len(order_by))]
    return df.select("*", *[col(c).alias(k) for c, k in zip(order_by, keys)]), keys


def union_all(parts: list[DataFrame], schema: str | None = None) -> DataFrame:
    """All parts below each other; without parts an empty table of the given schema."""
    if not parts and schema:
        return SparkSession.active().createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), parts)


def chunks(items: list, size: int) -> list[list]:
    step = max(size, 1)
    return [items[i : i + step] for i in range(0, len(items), step)]
