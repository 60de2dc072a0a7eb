"""Numbers, amounts and percentages as English words, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescout.functions.text import WHITESPACE, bind

# fixed values: English number words
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# fixed values: the parts that names of powers of a thousand are made of
LOW = "m b tr quadr quint sext sept oct non".split()
LATIN_UNITS = ["", *"un duo tre quattuor quin sex sept octo novem".split()]
LATIN_TENS = (
    "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint"
).split()


def _scales() -> list[str]:
    """thousand, million, .. nonillion, decillion, undecillion, .. centillion."""
    stems = [*LOW, *[unit + ten for ten in LATIN_TENS for unit in LATIN_UNITS], "cent"]
    return ["thousand", *[f"{stem}illion" for stem in stems]]


SCALES = _scales()
LONGEST_DIGITS = 3 * (len(SCALES) + 1)

# fixed values: what counts as an amount, a percentage and a plain number
CURRENCY = rf"\$(?:{WHITESPACE})?([0-9][0-9,]*)(?:\.([0-9]{{1,2}}))?"
PERCENT = rf"([0-9]+)(?:\.([0-9]+))?(?:{WHITESPACE})?%"
PLAIN = r"(?<![\p{L}\p{N}_.])([0-9][0-9,]*)(?:\.([0-9]+))?(?![\p{L}\p{N}_])"


def _below_thousand() -> list[str]:
    tens = UNITS + [
        t if u == 0 else f"{t}-{UNITS[u]}" for t in TENS for u in range(10)
    ]
    return tens + [
        f"{UNITS[h]} hundred" + (f" and {tens[r]}" if r else "")
        for h in range(1, 10)
        for r in range(100)
    ]


def _lookup(words: list[str], index: Column) -> Column:
    # one literal that the optimizer folds into a constant array
    return F.element_at(F.split(F.lit("|".join(words)), r"\|"), index + 1)


def digits_to_words(digits: Column) -> Column:
    """Words of a run of decimal digits; NULL for runs of more than 306, the last centillion.

    The run is padded to whole groups of three. Groups are separated by ", ", only a
    last group below one hundred is attached with " and ".
    """
    names = _below_thousand()

    def grouped(significant: Column) -> Column:
        groups = F.ceil(F.length(significant) / F.lit(3)).cast("int")
        padded = F.lpad(significant, groups * 3, F.lit("0"))
        values = F.transform(
            F.sequence(F.lit(0), groups - 1),
            lambda g: F.substring(padded, g * 3 + 1, F.lit(3)).cast("int"),
        )
        return bind(values, spoken)

    def spoken(values: Column) -> Column:
        scales = F.split(F.lit("|".join(reversed(SCALES))), r"\|")
        higher = F.filter(
            F.zip_with(
                F.slice(values, F.lit(1), F.size(values) - 1),
                F.slice(scales, F.lit(len(SCALES) + 2) - F.size(values), F.size(values) - 1),
                lambda v, s: F.when(v > 0, F.concat(_lookup(names, v), F.lit(" "), s)),
            ),
            lambda part: part.isNotNull(),
        )
        return bind(
            F.struct(F.array_join(higher, ", ").alias("head"), F.element_at(values, -1).alias("last")),
            joined,
        )

    def joined(parts: Column) -> Column:
        head, last = parts["head"], parts["last"]
        link = F.when(last < 100, F.lit(" and ")).otherwise(F.lit(", "))
        return F.when(last == 0, head).otherwise(F.concat(head, link, _lookup(names, last)))

    return bind(
        F.regexp_replace(digits, "^0+(?=[0-9])", ""),
        lambda d: F.when(F.length(d) <= 3, _lookup(names, d.cast("int"))).when(
            F.length(d) <= LONGEST_DIGITS, grouped(d)
        ),
    )


def int_to_words(number: Column) -> Column:
    """Words of an integer column; negative numbers start with "minus"."""
    spoken = digits_to_words(F.regexp_replace(number.cast("string"), "^-", ""))
    return F.concat(F.when(number < 0, "minus ").otherwise(""), spoken)


def _digit_by_digit(digits: Column) -> Column:
    return F.array_join(
        F.transform(F.regexp_extract_all(digits, F.lit("([0-9])")), lambda d: _lookup(UNITS, d.cast("int"))),
        " ",
    )


def _amount_words(found: Column) -> Column:
    whole = F.regexp_replace(F.regexp_extract(found, CURRENCY, 1), ",", "")
    fraction = F.regexp_extract(found, CURRENCY, 2)
    cents = F.rpad(fraction, 2, "0").cast("int")
    dollars = F.concat(digits_to_words(whole), F.when(whole == "1", " dollar").otherwise(" dollars"))
    with_cents = F.concat(
        dollars,
        F.lit(" and "),
        _lookup(_below_thousand(), cents),
        F.when(cents == 1, " cent").otherwise(" cents"),
    )
    return F.when((fraction != "") & (F.coalesce(cents, F.lit(0)) > 0), with_cents).otherwise(dollars)


def _decimal_words(whole: Column, fraction: Column) -> Column:
    spoken = digits_to_words(F.regexp_replace(whole, ",", ""))
    return F.when(fraction == "", spoken).otherwise(
        F.concat(spoken, F.lit(" point "), _digit_by_digit(fraction))
    )


def _percent_words(found: Column) -> Column:
    spoken = _decimal_words(F.regexp_extract(found, PERCENT, 1), F.regexp_extract(found, PERCENT, 2))
    return F.concat(spoken, F.lit(" percent"))


def _plain_words(found: Column) -> Column:
    # The surroundings were checked when the number was found, so the groups are
    # read off the found text without looking around.
    whole = F.regexp_extract(found, r"^([0-9][0-9,]*)", 1)
    return _decimal_words(whole, F.regexp_extract(found, r"\.([0-9]+)$", 1))


def _replace_each(text: Column, pattern: str, words: Callable[[Column], Column]) -> Column:
    """Replace every match by words(match); a match without words stays as it is."""

    def rebuilt(found: Column) -> Column:
        replaced = F.transform(found, lambda m: F.coalesce(words(m), m))
        pieces = F.zip_with(
            F.split(text, pattern, -1), replaced, lambda t, w: F.concat(t, F.coalesce(w, F.lit("")))
        )
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.isNotNull(), bind(found, rebuilt))


def speak_currency(text: Column) -> Column:
    return _replace_each(text, CURRENCY, _amount_words)


def speak_percent(text: Column) -> Column:
    return _replace_each(text, PERCENT, _percent_words)


def speak_numbers(text: Column) -> Column:
    return _replace_each(text, PLAIN, _plain_words)
