import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASH = "id size n text_ score label h kid nul gid token copies taken host total line _bad _lines n_lines n_dropped item variant".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text, lang, source), with many clashing extra columns."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *[f"'x{n}' as `{c}`" for n, c in enumerate(CLASH)])

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, repeated rows, ties and a very long text as (doc_id, text, lang, source)."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \t\n ", "en", "a"),
        (4, "one two", "en", "b"),
        (4, "one two", "en", "b"),
        (5, "One Two", "en", "b"),
        (None, "one two three four", "de", None),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, long + " tail", "en", "a"),
        (8, "!!! ??? 123", "fr", "c"),
        (9, "x" * 50_000, "en", "c"),
    ]
