import pytest
from pyspark.sql import functions as F

from tablescout.operators.dictionary import data_dictionary
from tablescout.plans.profile import SKIPPED, describe_folder, profile_folder
from tablescout.sources import catalog as catalogs
from tablescout.sources import files, listing, sinks
from tablescout.sources.listing import list_files


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_manifest(spark, tmp_path):
    put(tmp_path, "b.csv", "x\n1\n")
    put(tmp_path, "deep/er/UPPER.CSV", "x\n1\n")
    put(tmp_path, "deep/a b+c.tsv", "x\n1\n")
    put(tmp_path, "~$lock.csv", "x\n1\n")
    put(tmp_path, "other.parquet", "x")
    put(tmp_path, "run.py", "print(1)")
    rows = files.file_manifest(spark, str(tmp_path)).collect()
    assert [r["relative_path"] for r in rows] == ["b.csv", "deep/a b+c.tsv", "deep/er/UPPER.CSV"]
    assert [r["folder"] for r in rows] == ["(Root Folder)", "deep", "deep/er"]
    assert [r["stem"] for r in rows] == ["b", "a b+c", "UPPER"]
    with_locks = files.file_manifest(spark, str(tmp_path), skip_locks=False)
    assert with_locks.count() == 4
    scripts = files.file_manifest(spark, str(tmp_path), files.SCRIPT_SUFFIXES)
    assert [r["file_name"] for r in scripts.collect()] == ["run.py"]
    assert files.file_manifest(spark, str(tmp_path), [".py"], skip_names=["run.py"]).count() == 0


def test_manifest_is_complete(spark, tmp_path):
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "_hidden/.dot.csv", "x\n")
    put(tmp_path, "_under.csv", "x\n1\n")
    rows = files.file_manifest(spark, str(tmp_path)).collect()
    assert [(r["relative_path"], r["length"]) for r in rows] == [("_hidden/.dot.csv", 2), ("_under.csv", 4), ("empty.csv", 0)]


def test_listing_in_many_shares(spark, tmp_path):
    wanted = {put(tmp_path, f"a{i % 3}/b{i % 7}/c{i}/f{i}.csv", "x" * i) for i in range(60)}
    for shares in (1, 500, 16):
        listed = list_files(spark, str(tmp_path), shares)
        assert {r["path"] for r in listed.collect()} == wanted
    assert listed.rdd.getNumPartitions() > 8
    assert {(r["path"], r["length"]) for r in list_files(spark, f"file://{tmp_path}/a1/b1/c1").collect()} == {
        (str(tmp_path / "a1/b1/c1/f1.csv"), 1)
    }
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "none"))
    (tmp_path / "void").mkdir()
    assert list_files(spark, str(tmp_path / "void")).count() == 0


def test_listing_of_another_store(spark, tmp_path):
    put(tmp_path, "a/empty.csv", "")
    put(tmp_path, "a/_b.csv", "xy")
    rows = listing._store_listing(spark, f"file://{tmp_path}").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in rows) == [("_b.csv", 2), ("empty.csv", 0)]


def test_unique_names():
    assert files.unique_names(["a", "a", "b", "a"]) == ["a", "a (2)", "b", "a (3)"]
    assert files.unique_names(["a (2)", "a", "a"]) == ["a (2)", "a", "a (3)"]


def test_table_names_with_one_heavy_stem(spark):
    rows = [(f"p{i:04d}", "hot" if i % 3 else f"s{i % 10}") for i in range(900)]
    got = files.table_names(spark.createDataFrame(rows, "path string, stem string").repartition(7))
    named = {r["path"]: r["table_name"] for r in got.collect()}
    assert named == dict(zip([p for p, _ in rows], files.unique_names([s for _, s in rows])))


@pytest.mark.parametrize(
    ("content", "encoding", "value"),
    [
        ("k,v\n1,é\n".encode(), "utf-8", "é"),
        (b"k,v\n1,\x80\n", "cp1252", "€"),
        (b"k,v\n1,\x81\n", "latin-1", "\x81"),
    ],
)
def test_encodings(spark, tmp_path, content, encoding, value):
    path = put(tmp_path, "t.csv", content)
    traits = files.file_traits(spark, path).collect()
    assert [(t["path"], t["encoding"]) for t in traits] == [(path, encoding)]
    catalog, _ = catalogs.load_folder(spark, str(tmp_path))
    assert [tuple(r) for r in catalog["t"].collect()] == [(1, value)]


@pytest.mark.parametrize(
    ("header", "separator"),
    [("a|b|c", "|"), ("a\tb", "\t"), ("a;b", ";"), ("a,b c", ","), ("a b", " "), ("name", "\t")],
)
def test_separators(spark, tmp_path, header, separator):
    path = put(tmp_path, "t.txt", header + "\n1" + (separator + "2") * header.count(separator) + "\n")
    assert files.separator_of(spark, path) == separator
    catalog, _ = catalogs.load_folder(spark, str(tmp_path))
    assert catalog["t"].columns == header.split(separator)


def test_bad_lines(spark, tmp_path):
    put(tmp_path, "ragged.csv", "a,b\n1,2\n1,2,3\n4\n\n5,6\n")
    catalog, report = catalogs.load_folder(spark, str(tmp_path), bad_lines="skip")
    assert sorted(map(tuple, catalog["ragged"].collect())) == [(1, 2), (4, None), (5, 6)]
    assert report.first()["rows"] == 3
    catalog, report = catalogs.load_folder(spark, str(tmp_path))
    assert catalog == {}
    assert "more fields" in report.first()["status"]


def test_missing_tokens(spark, tmp_path):
    tokens = [t for t in files.null_if_missing.__globals__["MISSING_TOKENS"] if t]
    body = "".join(f'{i},"{t}"\n' for i, t in enumerate([*tokens, "", " ", "-", "none"]))
    put(tmp_path, "missing.csv", "i,v\n" + body)
    catalog, _ = catalogs.load_folder(spark, str(tmp_path))
    kept = catalog["missing"].where("v is not null").orderBy("i").collect()
    assert [r["v"] for r in kept] == [" ", "-", "none"]


def test_types_and_quotes(spark, tmp_path):
    put(
        tmp_path,
        "typed.csv",
        'i,d,b,t,z,q,q\n1,1.5,True,x,,"a ""b"", c",1\n 2 ,2,False,2020-01-01,,"two\nlines",2\n',
    )
    catalog, _ = catalogs.load_folder(spark, str(tmp_path))
    df = catalog["typed"]
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "string", "bigint"]
    assert [tuple(r) for r in df.orderBy("i").collect()] == [
        (1, 1.5, True, "x", None, 'a "b", c', 1),
        (2, 2.0, False, "2020-01-01", None, "two\nlines", 2),
    ]


def test_load_folder_skips_and_names(spark, tmp_path):
    put(tmp_path, "x/a.csv", "v\n1\n")
    put(tmp_path, "y/a.csv", "v\n2\n3\n")
    put(tmp_path, "blank.csv", "\n\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "_hidden.csv", "v\n1\n")
    catalog, report = catalogs.load_folder(spark, str(tmp_path))
    assert list(catalog) == ["a", "a (2)"]
    rows = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1]: r for r in report.collect()}
    assert [rows["x/a.csv"]["rows"], rows["y/a.csv"]["rows"]] == [1, 2]
    skipped = [r for r in report.collect() if r["status"].startswith("skipped")]
    assert [r["path"].rsplit("/", 1)[-1] for r in skipped] == ["_hidden.csv", "blank.csv", "empty.csv"]


def test_load_folder_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        for i in range(n):
            put(tmp_path, f"{n}/f{i}.{('csv', 'tsv', 'txt')[i % 3]}", "a,b\n1,x\n2,y\n" if i % 3 != 1 else "a\tb\n1.5\t\n")
        tracker = spark.sparkContext.statusTracker()
        group = f"load {n}"
        spark.sparkContext.setJobGroup(group, group)
        catalog, report = catalogs.load_folder(spark, str(tmp_path / str(n)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(catalog) == n and [r["rows"] for r in report.collect()] == [1 if i % 3 == 1 else 2 for i in (
            sorted(range(n), key=lambda i: f"f{i}.{('csv', 'tsv', 'txt')[i % 3]}"))]
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(6) == jobs(30)


def test_folder_families_do_not_grow_with_files(spark, tmp_path):
    def found(n):
        for i in range(n):
            put(tmp_path, f"{n}/f{i}.csv", "a,b\n" if i == 1 else f'a,b\n{i},"x\ny{i}"\n' if i % 2 else f"a,b\n{i},x\n7,y{i}\n")
        catalog, _ = catalogs.load_folder(spark, str(tmp_path / str(n)))
        families = catalog.families()
        rows = []
        for family in families:
            rows += family.aggregate(family.rows, [F.count("b").alias("n"), F.max("b").alias("b")]).collect()
        whole = sum(family.rows.count() for family in families)
        assert sorted(r["table_name"] for r in rows) == sorted(catalog) and whole == sum(r["n"] or 0 for r in rows)
        for r in sorted(rows, key=lambda r: r["table_no"])[:3]:
            own = [x["b"] for x in catalog[r["table_name"]].collect()]
            assert (r["n"] or 0, r["b"]) == (len(own), max(own, default=None))
        return len(families)

    assert found(6) == found(18) == 3


def test_folder_dictionary_goes_by_families(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"p{i}.csv", "k,v,d\n" + "".join(f"{j},{'' if j % 3 else 'x'},{j}.5\n" for j in range(i)))
        put(tmp_path, f"q{i}.tsv", f'k\tv\n1\t"a\nb"\n2\t \n{i}\t2020-01-0{i + 1}\n')
        put(tmp_path, f"r{i}.csv", f"k,d\n1,\x80\n{i},2020-01-01\n".encode("latin-1"))
    catalog, _ = catalogs.load_folder(spark, str(tmp_path))
    together = data_dictionary(catalog)
    alone = data_dictionary({name: catalog[name] for name in catalog})
    assert together.columns == alone.columns
    assert together.collect() == alone.orderBy("slno").collect()
    # p0 has no row, so no types
    assert len(catalog.families()) == 4
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (together, alone)]
    assert 2 * scans[0] < scans[1]


def test_load_folder_isolates_unreadable_files(spark, tmp_path, monkeypatch):
    for i in range(7):
        put(tmp_path, f"f{i}.csv", "a\n1\n")
    real = catalogs.file_traits

    def failing(session, paths, *rest):
        if any(p.endswith(("f2.csv", "f5.csv")) for p in paths):
            raise OSError("cannot be read")
        return real(session, paths, *rest)

    monkeypatch.setattr(catalogs, "file_traits", failing)
    catalog, report = catalogs.load_folder(spark, str(tmp_path))
    assert list(catalog) == ["f0", "f1", "f3", "f4", "f6"]
    assert {r["path"][-6:] for r in report.where("status like 'skipped: cannot%'").collect()} == {"f2.csv", "f5.csv"}


def test_quoted_line_feeds_and_inch_marks(spark, tmp_path):
    put(tmp_path, "inch.csv", 'size,v\n5" pipe,1\n6" pipe,2\n')
    put(tmp_path, "open.csv", '\n \nk,"two\nlines"\n1,"a\n\nb, ""c"""\n2,"x"\n\n3,"never\n4,y\n')
    traits = {r["path"][-8:]: r["open_quotes"] for r in files.file_traits(spark, str(tmp_path)).collect()}
    assert traits == {"inch.csv": False, "open.csv": True}
    catalog, report = catalogs.load_folder(spark, str(tmp_path))
    assert catalog["open"].columns == ["k", "two\nlines"]
    got = sorted(map(tuple, catalog["open"].collect()))
    assert got[:2] == [(1, 'a\n\nb, "c"'), (2, "x")] and [r[0] for r in got] == [1, 2, 3, 4]
    assert sorted(map(tuple, catalog["inch"].collect())) == [('5" pipe', 1), ('6" pipe', 2)]
    assert [r["rows"] for r in report.orderBy("table_no").collect()] == [2, 4]


def test_load_report_names_the_missing(spark, small):
    rows = catalogs.load_report(spark, small, ["nation", "nothing"]).orderBy("table_no").collect()
    assert (rows[0]["rows"], rows[0]["status"]) == (25, "loaded")
    assert rows[1]["rows"] is None and rows[1]["status"].startswith("skipped")


def test_text_catalog(spark, tmp_path):
    put(tmp_path, "bom.sql", b"\xef\xbb\xbfselect 1\r\nGO\r\n")
    put(tmp_path, "bad.sql", b"a\xffb")
    texts = {r["path"][-7:]: r["text"] for r in files.text_catalog(spark, str(tmp_path), [".sql"]).collect()}
    assert texts == {"bom.sql": "select 1\nGO\n", "bad.sql": "a�b"}
    ignored = files.text_catalog(spark, str(tmp_path), [".sql"], errors="ignore")
    assert {r["text"] for r in ignored.collect()} == {"select 1\nGO\n", "ab"}
    lines = files.text_lines(ignored.where(F.col("path").endswith("bom.sql"))).orderBy("line_no")
    assert [(r["line_no"], r["line"]) for r in lines.collect()] == [(1, "select 1"), (2, "GO")]


def test_write_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"')], "i int, s string")
    for kind in ("parquet", "json", "csv"):
        written = sinks.write_reports({"one": df, "two": df}, str(tmp_path / kind), kind)
        assert [r["report"] for r in written.collect()] == ["one", "two"]
    assert spark.read.parquet(str(tmp_path / "parquet/one")).first()["s"] == 'a "b"'


def test_profile_folder(spark, tmp_path):
    keys = "".join(f"{i},{i % 5}\n" for i in range(40))
    put(tmp_path, "in/orders.csv", "order_id,cust_id\n" + keys)
    put(tmp_path, "in/customers.csv", "cust_id,name\n" + "".join(f"{i},n{i}\n" for i in range(5)))
    out = str(tmp_path / "out")
    written = profile_folder(spark, str(tmp_path / "in"), out, clusters=False)
    names = {r["report"] for r in written.collect()}
    assert names == {
        "load_report",
        "data_dictionary",
        "dimensions_and_keys",
        "column_similarity",
        "outliers",
        "clusters",
        "correlation",
    }
    best = spark.read.parquet(f"{out}/column_similarity").orderBy(F.desc("match_percent")).first()
    assert {best["column_1"], best["column_2"]} == {"cust_id"} and best["match_percent"] == 100.0
    assert spark.read.parquet(f"{out}/clusters").first()["note"] == SKIPPED


def test_describe_folder_follows_the_lines(spark, tmp_path):
    put(tmp_path, "t.csv", "v,w\n9,a\n3,b\n3,c,extra\n7,b\n8,\n1,b\n")
    rows = {r["column_name"]: r for r in describe_folder(spark, str(tmp_path)).collect()}
    assert [rows["v"][f"row_{i}"] for i in range(1, 5)] == ["9", "3", "7", "8"]
    assert [rows["w"][f"row_{i}"] for i in range(1, 5)] == ["a", "b", "b", ""]
    assert rows["v"]["table_rows"] == 5 and rows["v"]["mean"] == "5.6" and rows["w"]["mode"] == "b"


def test_long_ids_keep_their_digits(spark, tmp_path):
    ids = ["9007199254740993", "9223372036854775806", "9223372036854775807"]
    huge = [str(10**30 + i) for i in range(3)]
    over = [str(10**45 + i) for i in range(3)]
    lines = ["a,b,c"] + [",".join(x) for x in zip(ids, huge, over, strict=True)]
    path = tmp_path / "ids.csv"
    path.write_text("\n".join(lines) + "\n")
    df = files.read_delimited(spark, str(path), files.FileTraits())
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert [tuple(str(x) for x in r) for r in df.orderBy("a").collect()] == list(zip(ids, huge, over, strict=True))


def test_folder_files_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    (tmp_path / "c.txt").write_text("x;y;z\n3;4;5\n")
    (tmp_path / "d.txt").write_text("x|y\n6|7\n")
    rows = files.read_table_folder(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(1, 2, None), (3, 4, 5), (6, 7, None), (10, 20, None)]


def test_encodings_are_tried_in_the_given_order(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("x\né\n".encode())
    assert files.file_traits(spark, str(path)).first()["encoding"] == "utf-8"
    assert files.file_traits(spark, str(path), ["latin-1", "utf-8"]).first()["encoding"] == "latin-1"
    assert files.read_table_folder(spark, str(tmp_path), encodings=["latin-1"]).first()[0] == "Ã©"
    path.write_bytes(b"x\n\x81\n")
    with pytest.raises(ValueError):
        files.read_table_folder(spark, str(tmp_path), encodings=["utf-8"])
    with pytest.raises(ValueError):
        files.file_traits(spark, str(path), ["ebcdic"])
