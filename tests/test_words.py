import pytest
from pyspark.sql import functions as F

from tablescout.functions import words
from tablescout.operators import narrate

SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

SCALES = "thousand million billion trillion quadrillion quintillion sextillion".split()


def spell(n):
    """Words by repeated division, largest scale first."""
    if n < 20:
        return SMALL[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{SMALL[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{SMALL[n // 100]} hundred" + (f" and {spell(n % 100)}" if n % 100 else "")
    for i, scale in reversed(list(enumerate(SCALES, start=1))):
        power = 1000**i
        if n >= power:
            head, rest = f"{spell(n // power)} {scale}", n % power
            return head + ("" if not rest else f" and {spell(rest)}" if rest < 100 else f", {spell(rest)}")
    raise ValueError(n)


def spoken(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_integers(spark):
    numbers = [*range(0, 1200), 1999, 2000, 2001, 10_000, 99_099, 100_000, 1_000_001, 1_001_000]
    numbers += [1_000_100, 1_234_567, 999_999_999, 10**9, 10**12 + 7, 987_654_321_012_345]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    rows = df.select("n", words.int_to_words(F.col("n")).alias("w"), words.int_to_words(-F.col("n")).alias("m"))
    for row in rows.collect():
        assert row["w"] == spell(row["n"])
        assert row["m"] == ("minus " if row["n"] else "") + spell(row["n"])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$1", "one dollar"),
        ("$1.01", "one dollar and one cent"),
        ("pay $1,234.5 now", "pay one thousand, two hundred and thirty-four dollars and fifty cents now"),
        ("$ 7.00", "seven dollars"),
        ("$3.999", "three dollars and ninety-nine cents9"),
        ("$0", "zero dollars"),
        ("no amount", "no amount"),
    ],
)
def test_currency(spark, text, expected):
    assert spoken(spark, words.speak_currency, [text]) == [expected]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("5%", "five percent"),
        ("0.05 %", "zero point zero five percent"),
        ("1,234%", "1,two hundred and thirty-four percent"),
        ("12.50%!", "twelve point five zero percent!"),
    ],
)
def test_percent(spark, text, expected):
    assert spoken(spark, words.speak_percent, [text]) == [expected]


def test_digits_beyond_forty(spark):
    """80 nines: the names of all groups in their order."""
    names = (
        "quinvigintillion quattuorvigintillion trevigintillion duovigintillion unvigintillion vigintillion "
        "novemdecillion octodecillion septdecillion sexdecillion quindecillion quattuordecillion tredecillion "
        "duodecillion undecillion decillion nonillion octillion septillion sextillion quintillion quadrillion "
        "trillion billion million thousand"
    ).split()
    full = "nine hundred and ninety-nine"
    expected = ", ".join([f"ninety-nine {names[0]}", *[f"{full} {n}" for n in names[1:]], full])
    assert spoken(spark, words.speak_numbers, ["9" * 80]) == [expected]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("in 2020, we", "in two thousand and twenty we"),
        ("a 3.14 b", "a three point one four b"),
        ("x5 5x über5 _5", "x5 5x über5 _5"),
        ("1.5a", "one.5a"),
        ("12,a", "twelve,a"),
        (".5", ".5"),
        ("007", "seven"),
        ("(1,000)", "(one thousand)"),
        ("5. 6", "five. six"),
        ("1" + "0" * 39, "one duodecillion"),
        ("2" + "0" * 62 + "7", "two vigintillion and seven"),
        ("1" + "0" * 305, "one hundred centillion"),
        ("9" * 307, "9" * 307),
    ],
)
def test_plain_numbers(spark, text, expected):
    assert spoken(spark, words.speak_numbers, [text]) == [expected]


def test_whole_documents_keep_what_is_no_number(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    given = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["text"] for r in narrate.normalize_text(documents, "text").collect()}
    assert got.keys() == given.keys()
    numbers = 0
    for key, text in given.items():
        said = iter(got[key].split())
        for token in text.split():
            if any(c.isdigit() or c in "$%" for c in token):
                numbers += token.isdigit() and token.isascii()
            else:
                assert any(token == word for word in said), (key, token)
        assert not [w for w in got[key].split() if w.isascii() and w.isdigit() and len(w) < 30]
    assert numbers


MIXED = {
    "$5 and 5% of 5": "five dollars and five percent of five",
    "1 2 3": "one two three",
    "a$1,b 2%c": "aone dollarb two percentc",
    "10.5.2020": "ten point five.2020",
    "v1.2 3.4.": "v1.2 three point four.",
    "$1.5% 7": "one dollar and fifty cents% seven",
    "1,2,3,": "one hundred and twenty-three",
    "\x01 4 \x02": "\x01 four \x02",
}


def test_mixed_texts(spark):
    rows = spark.createDataFrame(list(enumerate(MIXED)), "i int, v string")
    got = [r["v"] for r in narrate.normalize_text(rows, "v").orderBy("i").collect()]
    assert got == list(MIXED.values())
