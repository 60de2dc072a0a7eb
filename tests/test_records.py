"""Records over split files against a reader that goes through the file once."""

import random

import pytest

from tablescout.sources import records


def once(text, sep):
    """(records, whether a quote stays open): fields are quoted from their first character on."""
    lines, out, inside, i = text.split("\n"), [], False, 0
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    start = 0
    while i < len(lines):
        if not inside:
            start = i
        inside = ends(lines[i], sep, inside)
        if not inside:
            out.append("\n".join(lines[start : i + 1]))
        elif i == len(lines) - 1:
            out += lines[start:]
        i += 1
    return out


def ends(line, sep, inside):
    i, fresh = 0, True
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                inside, fresh = False, False
        elif c == '"' and fresh:
            inside = True
        else:
            fresh = c == sep
        i += 1
    return inside


LINES = ['a,b', '"a","b"', 'x,"open', 'still', 'closed",y', '5" pipe,z', '"say ""hi""",1', '"', 'a,""', '"",', 'x,"a""', '",b', '', '"a" b,c', '"""', 'q","w']


@pytest.mark.parametrize("line", LINES)
def test_states(spark, line):
    df = spark.createDataFrame([(line,)], "line string").withColumn("p", records.quote_pieces("line"))
    got = df.select(records.ends_inside(df.p, ",").alias("o"), records.ends_inside(df.p, ",", inside=True).alias("i")).first()
    assert tuple(got) == (ends(line, ",", False), ends(line, ",", True))


@pytest.mark.parametrize("seed", range(6))
def test_records_of_split_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    wanted = {}
    for name in "abc":
        body = "\n".join(rng.choice(LINES if rng.random() < 0.5 else LINES[:2]) for _ in range(rng.randrange(1, 120))) + "\n"
        (tmp_path / f"{name}.csv").write_text("h,i\n" + body)
        wanted[name] = once("h,i\n" + body, ",")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = records.file_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 3
        judged = records.judged_lines(lines, ",")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(records.records(judged).collect(), key=lambda r: (r["file"], r["block"], r["at"])):
        got.setdefault(r["file"][-5], []).append((r["record"], r["is_header"]))
    assert {k: [x for x, _ in v] for k, v in got.items()} == wanted
    assert all([h for _, h in v] == [True] + [False] * (len(v) - 1) for v in got.values())
