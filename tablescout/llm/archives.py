"""Legacy ARC archives: written, converted to WARC and read back.

An ARC file starts with a version block (`filedesc://`) that says which URL-record line
follows: version 1 has five fields, version 2 ten; the last one is the length of the
content in bytes. The converter reads line and length, never the content, to find the next
record, and makes up what WARC asks for: record ids (from file and offset, so that a second
run gives the same), ISO timestamps, types and SHA-1 digests.

Of records with equal payloads the one with the smallest page id stays a response, the
others become revisits of it; payloads under `min_revisit_bytes` are never revisited.

Scale: an archive is filled up to `archive_bytes` and becomes one gzip file through Spark's
own text writer (its commit protocol covers lost tasks), so reading takes one file at a
time. Digests are grouped without the payloads; only digests that occur twice are joined
back, from a written table, which Spark broadcasts while it is small and else joins by
shuffle with adaptive skew handling.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import check_columns, kept, small_batches
from tablescout.session import scratch_path

# fixed values: the record lines that the two versions announce
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = (
    "URL IP-address Archive-date Content-type Result-code "
    "Checksum Location Offset Filename Archive-length"
)
ARCHIVE_BYTES = 16 << 20
UNSAFE = re.compile(r"[\x00-\x20\x7f]")

PARSED = (
    "record_id string, page_id long, uri string, ip string, date string, kind string, "
    "mime string, head binary, payload binary, payload_bytes long, payload_digest string"
)
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, record_id string, uri string, warc_date string"
)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_archive(records: Iterable[tuple], version: int, name: str, date: str) -> bytes:
    """The bytes of one ARC file; a record is (url, ip, date, mime, content)."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    about = f"{version} 0 tablescout\n{fields}\n".encode()
    middle = "" if version == 1 else "200 - - 0 - "
    parts = [f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(about)}\n".encode(), about, b"\n"]
    offset = sum(map(len, parts))
    for url, ip, when, mime, content in records:
        check = hashlib.md5(content).hexdigest()
        middle = "" if version == 1 else f"200 {check} - {offset} {name} "
        line = f"{url} {ip} {when} {mime} {middle}{len(content)}\n".encode()
        parts += [line, content, b"\n"]
        offset += len(line) + len(content) + 1
    return b"".join(parts)


def opened(raw: bytes) -> io.BufferedIOBase:
    plain = io.BytesIO(raw)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain)) if raw[:2] == b"\x1f\x8b" else plain


def exactly(stream: io.BufferedIOBase, length: int) -> bytes:
    """So many bytes of the stream, or an error where it ends before."""
    data = stream.read(length)
    if len(data) < length:
        raise ValueError(f"archive ends {length - len(data)} bytes before its declared length")
    return data


def arc_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(record number, header fields, content) of every record after the version block."""
    stream, names, number = opened(raw), None, 0
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        values = text.split(" ")
        if text.startswith("filedesc://"):
            about = exactly(stream, int(values[-1])).decode("utf-8", "replace").split("\n")
            version = about[0].split(" ")[0]
            names = {"1": V1_FIELDS, "2": V2_FIELDS}.get(version)
            if names is None:
                raise ValueError(f"ARC version {version!r} is not known")
            names = names.split(" ")
            if len(values) != len(names):
                raise ValueError("the version block's line does not fit its version")
            continue
        if names is None:
            raise ValueError("no version block before the first record")
        if len(values) != len(names):
            raise ValueError(f"a record line has {len(values)} fields, version wants {len(names)}")
        fields = dict(zip(names, values, strict=True))
        yield number, fields, exactly(stream, int(fields["Archive-length"]))
        number += 1


def iso_date(digits: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC timestamp."""
    d = (digits + "00000000000000")[:14] if len(digits) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = block.find(gap)
        if at >= 0:
            return block[: at + len(gap)], block[at + len(gap) :]
    return block, b""


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def record_uuid(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of every record, by declared lengths."""
    stream = opened(raw)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, exactly(stream, int(fields["content-length"]))


def packed(batches: Iterable, make, most: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered into archives of about `most` bytes, one row each.

    The last byte of an archive is a line feed; it is left to the text writer.
    """
    part, number = TaskContext.get().partitionId(), 0
    rows, held = [], 0
    for batch in batches:
        for row in make.rows(batch):
            rows.append(row)
            held += make.size(row)
            if held >= most:
                yield pa.RecordBatch.from_arrays([pa.array([make.archive(rows, part, number)[:-1]], pa.binary())], ["value"])
                rows, held, number = [], 0, number + 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([make.archive(rows, part, number)[:-1]], pa.binary())], ["value"])


class ArcPacker:
    """Pages as ARC archives; the versions take turns."""

    def __init__(self, date: str) -> None:
        self.date = date

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            payload = b"" if not html.is_valid else html.as_buffer().to_pybytes()
            named = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
            head = (
                "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"{named}Content-Length: {len(payload)}\r\n\r\n"
            )
            safe = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url.as_py() or "about:blank")
            yield safe, "0.0.0.0", self.date, "text/html", head.encode() + payload

    def size(self, row: tuple) -> int:
        return len(row[4]) + len(row[0]) + 100

    def archive(self, rows: list[tuple], part: int, number: int) -> bytes:
        return arc_archive(rows, 1 + (part + number) % 2, f"pages-{part}-{number}.arc", self.date)


class WarcPacker:
    """Parsed records as WARC archives, each after a warcinfo record."""

    NAMES = "record_id page_id uri ip date kind mime head payload payload_bytes payload_digest first_id first_page".split()

    def rows(self, batch: pa.RecordBatch) -> Iterator[dict]:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in self.NAMES]
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(self.NAMES, columns, strict=True)}

    def size(self, row: dict) -> int:
        return len(row["payload"]) + len(row["head"]) + 400

    def record(self, r: dict) -> bytes:
        again = r["first_id"] is not None and r["first_id"] != r["record_id"]
        page = str(r["first_page"]) if again and r["first_page"] is not None else None
        fields = [
            ("WARC-Type", "revisit" if again else r["kind"]),
            ("WARC-Record-ID", r["record_id"]),
            ("WARC-Date", r["date"]),
            ("WARC-Target-URI", r["uri"]),
            ("WARC-IP-Address", r["ip"]),
            ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]),
        ]
        if again:
            fields += [
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", r["first_id"]),
                ("X-Refers-To-Page-Id", page),
            ]
        block = r["head"] if again else r["head"] + r["payload"]
        return warc_record([*fields, ("Content-Type", r["mime"])], block)

    def archive(self, rows: list[dict], part: int, number: int) -> bytes:
        name = f"converted-{part}-{number}.warc"
        info = warc_record(
            [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", record_uuid(name + "#" + rows[0]["record_id"])),
                ("WARC-Date", rows[0]["date"]),
                ("WARC-Filename", name),
                ("Content-Type", "application/warc-fields"),
            ],
            b"software: tablescout\r\nformat: WARC File Format 1.1\r\n",
        )
        return b"".join([info, *map(self.record, rows)])


def _write(df: DataFrame, packer: object, path: str, most: int) -> None:
    archives = df.mapInArrow(lambda batches: packed(batches, packer, most), "value binary")
    writer = archives.select(F.col("value").cast("string")).write.option("compression", "gzip")
    writer.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_arc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "20240101000000",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write pages as gzip ARC files, each page an HTTP response that carries its id.

    A null payload is written as an empty one, a null URL as about:blank, white space in
    URLs is percent-encoded, a null id is left out of the response's head.
    """
    check_columns(pages, [id_col, url_col, html_col])
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")
    )
    _write(rows, ArcPacker(date), path, archive_bytes)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        [n for n, _ in fields],
    )


def _parse_arc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for number, f, block in arc_records(content.as_buffer().to_pybytes()):
                web = block.startswith(b"HTTP/")
                head, payload = http_parts(block) if web else (b"", block)
                page = http_field(head, "X-Page-Id")
                place = f"{path.as_py().rpartition('/')[2]}#{number}"
                rows.append((
                    record_uuid(place), int(page) if page else None, f["URL"], f["IP-address"],
                    iso_date(f["Archive-date"]), "response" if web else "resource",
                    "application/http; msgtype=response" if web else f["Content-type"],
                    head, payload, len(payload), digest_of(payload),
                ))
                held += len(block)
                if held >= 1 << 20:
                    yield _batch(PARSED, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(PARSED, rows)


def convert_arc(
    spark: SparkSession,
    arc_path: str,
    warc_path: str,
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Convert all ARC files under a path to gzip WARC files under another.

    Responses keep their HTTP head; a revisit keeps the head and leaves the payload out.
    Records other than HTTP become resources with the type that the archive names. Where
    equal payloads share the smallest page id too, one of them is the response. Records
    without a page id come after all others. Broken lengths or lines are errors.
    """
    parsed = _binary_files(spark, arc_path).mapInArrow(_parse_arc, PARSED)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    twice = (
        parsed.filter((F.col("payload_bytes") >= min_revisit_bytes) & (F.col("kind") == "response"))
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            F.col("payload_digest").alias("_digest"),
            F.col("payload_bytes").alias("_bytes"),
            F.col("first.record_id").alias("first_id"),
            F.col("first.page_id").alias("first_page"),
        )
    )
    twice = kept(twice, "warc-twice")
    same = (
        (F.col("payload_digest") == F.col("_digest"))
        & (F.col("payload_bytes") == F.col("_bytes"))
        & (F.col("kind") == "response")
    )
    joined = parsed.join(twice, same, "left").drop("_digest", "_bytes")
    _write(joined, WarcPacker(), warc_path, archive_bytes)


def _parse_warc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for f, block in warc_records(content.as_buffer().to_pybytes()):
                kind = f["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                head, payload = http_parts(block)
                size = int(http_field(head, "Content-Length") or len(payload))
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                    raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                page, first = http_field(head, "X-Page-Id"), f.get("x-refers-to-page-id")
                rows.append((
                    int(page) if page else None, size, digest, kind, int(first) if first else None,
                    f["warc-record-id"], f["warc-target-uri"], f["warc-date"],
                ))
            if rows:
                yield _batch(READ, rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under a path; payloads are checked by digest."""
    return _binary_files(spark, path).mapInArrow(_parse_warc, READ)


def archived_pages(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages through ARC and WARC files in the shared folder and back.

    One row per input row: page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_id, uri, warc_date. Repeated rows are records of their own. An empty table gives
    no rows.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, archive_bytes=archive_bytes)
    convert_arc(spark, arc, warc, min_revisit_bytes, archive_bytes)
    return read_warc(spark, warc)
