"""One query per inventory row; every query runs over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from tablescout.functions.text import name_similarity
from tablescout.operators.columns import union_all
from tablescout.operators.numbering import number_rows
from tablescout.operators import (
    clusters,
    correlate,
    describe,
    dictionary,
    keys,
    narrate,
    outliers,
    preview,
    similarity,
    sqlruns,
)
from tablescout.functions import words
from tablescout.options import Options
from tablescout.session import scratch_path
from tablescout.sources import catalog as catalogs
from tablescout.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

ORDER = {
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "dirty_customer": ["c_custkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    "events": ["event_id"],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalogs.parquet_catalog(spark, sf_dir, [name])[name]


def _view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **catalogs.parquet_catalog(spark, sf_dir, tables))


def _catalog(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    found = {}
    for name in names:
        if name == "dirty_customer":
            found[name] = _view(spark, sf_dir, views.DIRTY_CUSTOMER, "customer")
        elif name == "dup_nation":
            found[name] = _view(spark, sf_dir, views.DUP_NATION, "nation")
        else:
            found[name] = _table(spark, sf_dir, name)
    return found


# ---- sources and sinks ---------------------------------------------------------


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the customers, one per segment, as the listing shows them."""
    path = scratch_path(spark, "manifest")
    customer = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    writer = customer.repartition("c_mktsegment").write.partitionBy("c_mktsegment")
    writer.option("header", True).csv(path)
    found = files.file_manifest(spark, path, [".csv"])
    return found.groupBy("folder", "suffix").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def script_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of other kinds and names, hidden and empty ones too, written from the nations and
    listed by suffix in path order."""
    root = scratch_path(spark, "scripts")
    sinks.write_files(_view(spark, sf_dir, views.SCRIPT_FILES, "nation"), root)
    parts = []
    for kind, suffixes, locks in (("sql", files.SQL_SUFFIXES, True), ("py", files.SCRIPT_SUFFIXES, False)):
        found = files.file_manifest(spark, root, suffixes, skip_locks=locks, skip_names=["n3.py"])
        numbered = number_rows(found.select("relative_path", "folder", "stem", "length"), ["relative_path"], name="place")
        parts.append(numbered.select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1])


def folder_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind written from the customers of a nation, loaded as a folder: an empty
    one, one with bad lines, one of equal stem in each folder, line feeds in quotes."""
    root = scratch_path(spark, "folder")
    sinks.write_files(_view(spark, sf_dir, views.CUSTOMER_FILES, "customer"), root)
    catalog, report = catalogs.load_folder(spark, root)
    sums = []
    for family in catalog.families():
        types = dict(family.rows.dtypes)
        top = F.max(F.col(family.columns[1]).cast("string")).alias("top")
        found = family.aggregate(family.rows, [F.sum("c_custkey").cast("bigint").alias("keys"), top])
        columns = F.lit(",".join(f"{c} {types[c]}" for c in family.columns)).alias("columns")
        sums.append(found.select("table_name", columns, "keys", "top"))
    table = F.regexp_replace("path", "^.*/folder-[0-9a-f]+/", "")
    found = report.select("table_no", "table_name", table.alias("path"), "rows", "status")
    return found.join(union_all(sums), "table_name", "left")


def folder_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data dictionary of the same folder."""
    root = scratch_path(spark, "folder")
    sinks.write_files(_view(spark, sf_dir, views.CUSTOMER_FILES, "customer"), root)
    catalog, _ = catalogs.load_folder(spark, root, bad_lines="skip")
    return dictionary.data_dictionary(catalog)


def quoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with quotes, separators and line feeds in their names, written and read back in
    splits; a file with inch marks only is read line by line."""
    path = scratch_path(spark, "quoted")
    part = _view(spark, sf_dir, views.QUOTED_PARTS, "part")
    writer = part.select("p_partkey", "label").write.option("header", True)
    writer.option("escape", '"').csv(path)
    read = files.read_table_folder(spark, path)
    return read.select("p_partkey", "label")


def sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator found in text files of customers, one folder for each separator."""
    path = scratch_path(spark, "sniffed")
    separators = F.array(*[F.lit(s) for s in files.SEPARATORS])
    kind = (F.col("c_custkey") % len(files.SEPARATORS)).cast("int")
    wanted = F.element_at(separators, kind + 1)
    line = F.concat(F.col("c_custkey").cast("string"), wanted, "c_mktsegment", wanted, F.col("c_nationkey").cast("string"))
    _table(spark, sf_dir, "customer").select(kind.alias("kind"), line.alias("value")).write.partitionBy("kind").text(path)
    found = files.file_traits(spark, path)
    number = F.regexp_extract("path", "/kind=([0-9]+)/", 1).cast("int")
    return found.groupBy(number.alias("kind"), "separator").agg(F.bool_or("open_quotes").alias("open_quotes"))


def read_two_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback of two encodings: bytes that are not UTF-8 are latin-1."""
    customer = _table(spark, sf_dir, "customer")
    parts = []
    for kind, mark in {"utf8": "é", "other": "\x80"}.items():
        path = scratch_path(spark, kind)
        customer.select("c_custkey", F.concat(F.lit(mark), "c_name").alias("label")).write.option(
            "header", True
        ).option("encoding", "UTF-8" if kind == "utf8" else "ISO-8859-1").csv(path)
        read = files.read_table_folder(spark, path, encodings=["utf-8", "latin-1"])
        parts.append(read.select(F.lit(kind).alias("kind"), "c_custkey", "label"))
    return parts[0].unionByName(parts[1])


def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _view(spark, sf_dir, views.FILES, "part")
    return files.table_names(listed).select("path", "table_name")


def read_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in three encodings, recognised and read back."""
    customer = _table(spark, sf_dir, "customer")
    marks = {"utf8": "é", "cp1252": "\x80", "latin1": "\x81"}
    parts = []
    for kind, mark in marks.items():
        path = scratch_path(spark, kind)
        customer.select("c_custkey", F.concat(F.lit(mark), "c_name").alias("label")).write.option(
            "header", True
        ).option("encoding", "UTF-8" if kind == "utf8" else "ISO-8859-1").csv(path)
        read = files.read_table_folder(spark, path)
        parts.append(read.select(F.lit(kind).alias("kind"), "c_custkey", "label"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    separators = F.array(*[F.lit(s) for s in files.SEPARATORS])
    wanted = F.element_at(separators, (F.col("c_custkey") % len(files.SEPARATORS)).cast("int") + 1)
    line = F.concat(F.col("c_custkey").cast("string"), wanted, "c_name", wanted, "c_mktsegment")
    return customer.select("c_custkey", files.sniff_separator(line).alias("separator"))


def read_skip_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines, some with a field too many or too few."""
    path = scratch_path(spark, "ragged")
    number = F.col("c_custkey").cast("string")
    line = (
        F.when(F.col("c_custkey") % 10 == 3, F.concat_ws(",", number, "c_name", "c_mktsegment", F.lit("x")))
        .when(F.col("c_custkey") % 10 == 7, F.concat_ws(",", number, "c_name"))
        .otherwise(F.concat_ws(",", number, "c_name", "c_mktsegment"))
    )
    _table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    rows = files.read_text_table(
        spark, path, files.FileTraits(), names=["c_custkey", "c_name", "c_mktsegment"]
    )
    return files.infer_types(files.skip_bad_lines(rows))


def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.missing_tokens_to_null(_view(spark, sf_dir, views.TOKEN_TEXTS, "customer"))


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.load_report(spark, sf_dir, TABLES).drop("path")


def write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written together and read back, as one list of distinct counts."""
    found = _catalog(spark, sf_dir, "customer", "orders")
    written = sinks.write_reports(
        {name: keys.cardinality({name: df}) for name, df in found.items()},
        scratch_path(spark, "reports"),
    )
    paths = [row["path"] for row in written.collect()]
    return spark.read.parquet(*paths)


def text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files per language, read whole and split into lines."""
    path = scratch_path(spark, "texts")
    documents = _table(spark, sf_dir, "documents").select("lang", "text")
    documents.write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    lines = files.text_lines(files.text_catalog(spark, path, [".txt"]))
    lang = F.regexp_extract("path", r"/lang=([^/]*)/", 1).alias("lang")
    return lines.groupBy(lang).agg(F.count(F.lit(1)).alias("lines"))


def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalog(spark, sf_dir, "nation", "customer", "orders", "events")
    return preview.table_preview(found, ORDER, Options(preview_columns=4)).select(
        "table_name", "total_rows", "row_no", F.array_join("cells", " | ").alias("cells"), "not_shown"
    )


# ---- columns -------------------------------------------------------------------


def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.data_dictionary(
        _catalog(spark, sf_dir, "customer", "orders", "dirty_customer", "dup_nation", "embeddings")
    )


def dtype_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dtype_labels(
        _catalog(spark, sf_dir, "dirty_customer", "part", "lineitem", "events", "documents")
    )


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.cardinality(_catalog(spark, sf_dir, "dirty_customer", "dup_nation", "lineitem", "events"))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_rows(_catalog(spark, sf_dir, "dup_nation", "orders", "lineitem", "documents"))


def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_candidates(
        _catalog(spark, sf_dir, "nation", "dup_nation", "dirty_customer", "orders", "part")
    )


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.numeric_summary(_catalog(spark, sf_dir, "dirty_customer", "orders", "lineitem"))


def column_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.column_mode(
        _catalog(spark, sf_dir, "dirty_customer", "dup_nation", "orders", "lineitem")
    )


def decimal_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of decimals, which sort as numbers, below and above zero."""
    return describe.column_mode({"priced": _view(spark, sf_dir, views.PRICED, "part")})


def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quartiles(_catalog(spark, sf_dir, "dirty_customer", "orders", "lineitem", "events"))


def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_report(
        _catalog(spark, sf_dir, "dirty_customer", "orders", "lineitem", "events")
    )


def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return outliers.outlier_rows(events, "value").select("event_id", "event_type", "value")


def outlier_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_examples(
        _catalog(spark, sf_dir, "dirty_customer", "part", "events"), ORDER
    )


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.first_rows(
        _catalog(spark, sf_dir, "nation", "dirty_customer", "orders", "events"), ORDER
    )


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe_tables(_catalog(spark, sf_dir, "dirty_customer", "events"), ORDER)


def describe_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that fail are named, the others and an empty table leave the report whole."""
    orders = _table(spark, sf_dir, "orders")
    catalog = {"failing": _view(spark, sf_dir, views.FAILING, "orders"), "empty": orders.where("o_orderkey < 0")}
    return describe.describe_tables(catalog, {"failing": ["o_orderkey"], "empty": ["o_orderkey"]})


def correlation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlation_report(
        _catalog(spark, sf_dir, "dirty_customer", "part", "orders", "lineitem")
    )


def correlation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlation_report({"wide": _view(spark, sf_dir, views.WIDE, "lineitem")})


# ---- similarity ----------------------------------------------------------------

RELATED = ("nation", "customer", "orders", "supplier")


def value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.value_sample(_catalog(spark, sf_dir, *RELATED))


def value_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.value_patterns(_catalog(spark, sf_dir, "dirty_customer", *RELATED))


def name_similarity_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.round(name_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("similarity"),
    )


def column_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.column_pairs(_catalog(spark, sf_dir, *RELATED))


def value_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.value_overlap(_catalog(spark, sf_dir, *RELATED))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard(_catalog(spark, sf_dir, *RELATED))


def column_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.column_similarity(_catalog(spark, sf_dir, *RELATED))


# ---- clusters ------------------------------------------------------------------

CLUSTERED = ("customer", "supplier", "part")


def silhouette_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_scores(_catalog(spark, sf_dir, *CLUSTERED))


def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(_catalog(spark, sf_dir, *CLUSTERED))


# ---- SQL runs ------------------------------------------------------------------


def sql_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlruns.sql_batches(_view(spark, sf_dir, views.SCRIPTS, "customer"))


def _run(spark: SparkSession, sf_dir: str, scripts: DataFrame | None = None) -> sqlruns.SqlRun:
    def prepare(session: SparkSession) -> None:
        for name, df in catalogs.parquet_catalog(session, sf_dir, ["customer", "orders"]).items():
            df.createOrReplaceTempView(name)

    if scripts is None:
        scripts = spark.createDataFrame(list(views.SQL_FILES.items()), "path string, text string")
    return sqlruns.run_sql_files(spark, scripts, max_rows=4, prepare=prepare)


def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rows.select(
        "path",
        "batch_no",
        "result_set_no",
        "row_no",
        F.array_join("columns", ",").alias("columns"),
        F.array_join("cells", " | ").alias("cells"),
        "truncated",
    )


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, _view(spark, sf_dir, views.NATION_SCRIPTS, "nation"))
    failed = run.batches.groupBy("path").agg(F.count("error").alias("failed_batches"))
    return run.files.join(failed, "path", "left").select(
        "path",
        "folder",
        "file_name",
        "status",
        F.coalesce("failed_batches", F.lit(0).cast("bigint")).alias("failed_batches"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = _view(spark, sf_dir, views.NATION_SCRIPTS, "nation")
    return sqlruns.run_summary(_run(spark, sf_dir, scripts).files)


def folder_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlruns.folder_breaks(_view(spark, sf_dir, views.FILES, "part"))


def format_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = _view(spark, sf_dir, views.DIRTY_CUSTOMER, "customer")
    return preview.format_cells(dirty.withColumn("code_shape", F.col("code_shape").cast("binary")))


# ---- narration -----------------------------------------------------------------


def narrate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = _view(spark, sf_dir, views.DIRTY_CUSTOMER, "customer")
    return narrate.describe_table(dirty, ORDER["dirty_customer"])


def assemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrate.assemble_document(_view(spark, sf_dir, views.BLOCKS, "conversations"))


def int_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 7654321 - 1000000).alias("number")
    )
    return narrate.integer_words(orders, "number", "words")


def speak_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.AMOUNTS, "customer").select(
        "c_custkey", words.speak_currency(F.col("text")).alias("text")
    )


def speak_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.AMOUNTS, "customer").select(
        "c_custkey", words.speak_percent(F.col("text")).alias("text")
    )


def speak_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.TOTALS, "orders").select(
        "o_orderkey", words.speak_numbers(F.col("text")).alias("text")
    )


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrate.normalize_text(_view(spark, sf_dir, views.AMOUNTS, "customer"), "text")


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return narrate.normalize_text(documents, "text")


def queries() -> dict[str, Query]:
    listed: list[Query] = [
        file_manifest,
        script_listing,
        folder_load,
        folder_profile,
        quoted_records,
        sniffed_files,
        read_two_encodings,
        table_names,
        read_encoded,
        sniff_delimiter,
        read_skip_bad,
        na_tokens,
        load_report,
        write_reports,
        text_catalog,
        table_preview,
        data_dictionary,
        dtype_labels,
        cardinality,
        duplicate_rows,
        key_candidates,
        numeric_summary,
        column_mode,
        decimal_modes,
        quartiles,
        outlier_report,
        outlier_rows,
        outlier_examples,
        first_rows,
        describe_table,
        describe_failing,
        correlation_report,
        correlation_wide,
        value_sample,
        value_patterns,
        column_pairs,
        value_overlap,
        jaccard,
        column_similarity,
        silhouette_1d,
        cluster_report,
        sql_batches,
        sql_rows,
        file_status,
        run_summary,
        folder_breaks,
        format_cells,
        narrate_rows,
        assemble_document,
        int_to_words,
        speak_currency,
        speak_percent,
        speak_numbers,
        normalize_text,
        normalize_documents,
    ]
    return {q.__name__: q for q in listed} | {"name_similarity": name_similarity_of_parts}
