import base64
import gzip
import hashlib

import pytest

from tablescout.llm import archives
from tablescout.llm.archives import archived_pages, convert_arc, read_warc, write_arc
from tablescout.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, id int, value string"


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\nfiledesc://x 0 0 0 1\n"
    pages = [
        (5, "http://a/ b", "<p>é</p>", 1, "x"),
        (3, "http://b/", "<p>é</p>", 1, "x"),
        (3, "http://b/", "<p>é</p>", 1, "x"),
        (9, None, None, 1, "x"),
        (8, "", "", 1, "x"),
        (None, "http://c/", tricky, 1, "x"),
        (7, "http://d/", tricky, 1, "x"),
        (6, "http://e/", "long " * 100_000, 1, "x"),
    ]
    got = archived_pages(spark.createDataFrame(pages, SCHEMA).repartition(3), archive_bytes=1000).collect()
    assert len(got) == len(pages)
    first = {}
    for page, _, html, *_ in pages:
        key = (html or "").encode()
        first[key] = min(first.get(key, page), page if page is not None else 10**9) if first.get(key) is not None else page
    for r in got:
        html = {(html or "").encode() for page, _, html, *_ in pages if page == r["page_id"]}
        payload = next(h for h in html if len(h) == r["payload_bytes"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        least = min(p for p, _, h, *_ in pages if (h or "").encode() == payload and p is not None)
        if r["record_type"] == "revisit":
            assert r["refers_to"] == least
        else:
            assert r["page_id"] == least and r["refers_to"] is None
    assert sum(r["record_type"] == "response" for r in got) == 4


def test_small_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab", 1, ""), (2, "u", "ab", 1, "")], SCHEMA)
    assert {r["record_type"] for r in archived_pages(pages, min_revisit_bytes=3).collect()} == {"response"}
    empty = spark.createDataFrame([], SCHEMA)
    assert archived_pages(empty).count() == 0


def test_versions_and_types():
    records = [
        ("http://a/", "1.2.3.4", "19970102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi"),
        ("dns:a", "1.2.3.4", "199701020304", "text/dns", b"a. IN A 1.2.3.4\n\n"),
    ]
    for version in (1, 2):
        raw = archives.arc_archive(records, version, "x.arc", "19970102030405")
        for data in (raw, gzip.compress(raw[:60]) + gzip.compress(raw[60:])):
            got = list(archives.arc_records(data))
            assert [(f["URL"], c) for _, f, c in got] == [(r[0], r[4]) for r in records]
    assert archives.iso_date("199701020304") == "1997-01-02T03:04:00Z"
    assert archives.http_parts(b"HTTP/1.0 200 OK\n\nhi") == (b"HTTP/1.0 200 OK\n\n", b"hi")


def test_resources_are_converted(spark):
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages = spark.createDataFrame([(1, "http://a/", "x", 1, "")], SCHEMA)
    write_arc(pages, arc)
    convert_arc(spark, arc, warc)
    r = read_warc(spark, warc).first()
    assert (r["page_id"], r["uri"], r["warc_date"]) == (1, "http://a/", "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("cut", [b"x", b"filedesc://x 0.0.0.0 1 text/plain 400\n"])
def test_broken_archives(cut):
    with pytest.raises(ValueError):
        list(archives.arc_records(cut))
