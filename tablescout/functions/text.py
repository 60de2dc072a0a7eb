"""Text expressions: blanks, numbers and dates held as text, value shapes, name similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that count as white space when stripping
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# fixed values: tokens that mean "missing" in delimited files
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

BLANK_TEXT = rf"^{WHITESPACE}*$"
INTEGER_TEXT = rf"^{WHITESPACE}*[+-]?[0-9]+{WHITESPACE}*$"
NUMBER_TEXT = (
    rf"(?i)^{WHITESPACE}*[+-]?"
    r"(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity)"
    rf"{WHITESPACE}*$"
)

# fixed values: the date layouts tried on text columns, each with the shape a value
# must have before it is parsed, so that plain text never reaches the parser
DATE_LAYOUTS = (
    ("yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("yyyy-M-d H:mm", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}$"),
    ("yyyy-M-d H:mm:ss", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy-M-d H:mm:ss.[SSSSSSSSS][SSSSSS][SSS]", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}\.(?:[0-9]{3}){1,3}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.(?:[0-9]{3}){1,3})?(?:Z|[+-][0-9]{2}:[0-9]{2})$"),
    ("yyyy/M/d", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("M/d/yyyy H:mm", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$"),
    ("M/d/yyyy H:mm:ss", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
    ("M/d/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"),
    ("d/M/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"),
    ("M-d-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("d-M-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("d.M.yyyy", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"),
    ("d MMM yyyy", r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$"),
    ("d MMMM yyyy", r"^[0-9]{1,2} [A-Z][a-z]{2,8} [0-9]{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}$"),
)
LONGEST_DATE = 35  # characters


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def null_if_missing(c: Column) -> Column:
    """NULL for the missing-value tokens; a lone space is a value."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def display_number(c: Column) -> Column:
    """Text of a double without an exponent between 1e-4 and 1e16."""
    plain = c.cast("string")
    exact = plain.try_cast("decimal(38,20)").cast("string")
    trimmed = F.regexp_replace(exact, r"(\.[0-9]+?)0+$", "$1")
    size = F.abs(c)
    rewritten = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(rewritten, trimmed).otherwise(plain)


def match_text(c: Column, type_name: str) -> Column:
    """Text under which values of different tables are compared.

    Stripped and lower-cased; a double or decimal without fraction reads like the integer,
    so that a key column stored that way still meets its integer partner. Doubles are exact
    integers up to 2^53.
    """
    if type_name in ("float", "double"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) <= float(1 << 53))
        return F.lower(F.when(whole, d.cast("bigint").cast("string")).otherwise(display_number(d)))
    if type_name == "string":
        return F.lower(strip(c))
    if type_name.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.lower(c.cast("string"))


def _mark_runs(c: Column, inside: str, mark: str) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"([{inside}]+|[^{inside}]+)"), F.lit(1))
    marked = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(f"^[{inside}]"), F.concat(F.lit(mark), F.length(run).cast("string"))
        ).otherwise(run),
    )
    return F.array_join(marked, "")


def value_shape(c: Column, mode: str = "two_pass") -> Column:
    """Shape signature of a text value.

    ``two_pass`` measures letter runs first and digit runs of that result second, so
    the length of a letter run is itself measured (``ab-9981`` gives ``LD1-D4``).
    ``run_length`` measures both on the original text (``ab-9981`` gives ``L2-D4``).
    """
    if mode == "two_pass":
        return _mark_runs(_mark_runs(c, "A-Za-z", "L"), "0-9", "D")
    if mode != "run_length":
        raise ValueError(f"unknown shape mode: {mode}")
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.when(run.rlike("^[A-Za-z]"), F.concat(F.lit("L"), F.length(run).cast("string")))
            .when(run.rlike("^[0-9]"), F.concat(F.lit("D"), F.length(run).cast("string")))
            .otherwise(run),
        ),
        "",
    )


def sorted_tokens(c: Column) -> Column:
    """White-space separated tokens in order, joined by one space."""
    words = F.filter(F.split(c, rf"{WHITESPACE}+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


LONGEST_BIT_ROW = 61


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _subsequence_bits(a: Column, b: Column) -> Column:
    """Common subsequence length with one table row held in the bits of a bigint.

    A zero bit marks a place where the length grows by one; a has at most
    LONGEST_BIT_ROW letters, so that the sums stay below 2^63.
    """
    letters = _letters(F.reverse(a))
    places = F.map_from_entries(
        F.transform(
            F.array_distinct(letters),
            lambda c: F.struct(
                c,
                F.conv(
                    F.array_join(F.transform(letters, lambda x: F.when(x == c, "1").otherwise("0")), ""),
                    2,
                    10,
                ).cast("bigint"),
            ),
        )
    )

    def steps(held: Column) -> Column:
        ones, masks = held["ones"], held["masks"]

        def step(row: Column, letter: Column) -> Column:
            met = row.bitwiseAND(F.coalesce(F.try_element_at(masks, letter), F.lit(0).cast("bigint")))
            return bind(met, lambda m: (row + m).bitwiseOR(row - m).bitwiseAND(ones))

        return F.length(a) - F.bit_count(F.aggregate(_letters(b), ones, step))

    ones = F.expr(f"{(1 << LONGEST_BIT_ROW) - 1}L")
    all_ones = F.call_function("shiftright", ones, F.lit(LONGEST_BIT_ROW) - F.length(a))
    return bind(F.struct(all_ones.alias("ones"), places.alias("masks")), steps)


def _subsequence_rows(a: Column, b: Column) -> Column:
    """Common subsequence length for names of any length, one array per table row."""
    width = F.length(b)

    def next_row(row: Column, letter: Column) -> Column:
        def extend(acc: Column, j: Column) -> Column:
            best = F.when(
                letter == F.substring(b, j, F.lit(1)), F.element_at(row, j) + 1
            ).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(row, j + 1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), width), F.array(F.lit(0)), extend)

    return F.element_at(F.aggregate(_letters(a), F.array_repeat(F.lit(0), width + 1), next_row), -1)


def common_subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
        .when(F.length(a) <= LONGEST_BIT_ROW, _subsequence_bits(a, b))
        .otherwise(_subsequence_rows(a, b))
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Percent agreement of two names, whatever the order of their tokens."""

    def compared(names: Column) -> Column:
        left, right = names["a"], names["b"]
        total = F.length(left) + F.length(right)
        ratio = common_subsequence_length(left, right).cast("double") * 200.0 / total
        return F.when(left == right, F.lit(100.0)).otherwise(ratio)

    return bind(F.struct(sorted_tokens(a).alias("a"), sorted_tokens(b).alias("b")), compared)
