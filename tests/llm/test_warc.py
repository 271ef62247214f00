import base64
import gzip
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfeat.llm import warc
from sparkfeat.llm.queries import QUERIES
from sparkfeat.llm.warc import (
    BrokenArchive, inflated, read_archives, records, revisits, round_trip, write_archives,
)

BIG = "<p>é</p>" * 200
ROWS = [
    (1, "http://a/1", BIG), (2, None, BIG), (9, "http://a/ü \r\nX: y<z>", BIG), (3, "http://b", None),
    (4, "", ""), (5, "http://c", "x" * 999), (6, "http://c", "x" * 999), (7, "http://c", "x" * 1000),
    (8, "http://c", "x" * 1000), (None, "http://d", "x" * 1000), (None, "http://e", "y" * 2000),
    (None, "http://e", "y" * 2000), (10, "http://f", "z" * 3_000_000), (11, "http://f", "z" * 3_000_000),
    (12, "http://g", "w" * 1500), (12, "http://g", "w" * 1500), (13, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90),
]
SCHEMA = "page_id long, url string, html string"


def plain_rows(pages):
    last = {}
    for key, _, html in pages:
        if key is not None:
            last[html or ""] = max(last.get(html or "", key), key)
    out = []
    for key, _, html in pages:
        payload = (html or "").encode()
        best = last.get(html or "")
        other = len(payload) >= 1000 and best is not None and best != key
        digest = hashlib.sha1(payload).hexdigest()
        out.append((key, len(payload), digest, "revisit" if other else "response", best if other else None))
    return sorted(out, key=str)


def collected(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def archives(spark, pages, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    return write_archives(revisits(pages, "page_id", "url", "html"), folder)


def test_round_trip_of_hard_rows(spark, pages):
    assert collected(round_trip(spark, pages)) == plain_rows(ROWS)


def test_extra_columns_and_empty_tables(spark, pages):
    wide = pages.selectExpr("*", "'x' AS `key`", "1 AS same", "2 AS last", "'y' AS payload", "3 AS `rows`")
    assert collected(round_trip(spark, wide)) == plain_rows(ROWS)
    assert round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_come_back(archives):
    found = read_archives(archives).where("record_type = 'response'").collect()
    payloads = sorted(r["payload"].decode() for r in found)
    stored = [(html or "") for (_, _, html), row in zip(ROWS, map(kept, ROWS)) if row]
    assert payloads == sorted(stored)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in found)


def kept(row):
    mine = [r for r in plain_rows(ROWS) if r[0] == row[0] and r[2] == hashlib.sha1((row[2] or "").encode()).hexdigest()]
    return mine[0][3] == "response"


def test_archives_are_plain_gzip_of_framed_records(archives):
    """Read with nothing but gzip: members, headers and lengths."""
    kinds = []
    for entry in archives.collect():
        raw = open(entry["path"], "rb").read()
        assert len(raw) == entry["bytes"]
        text, count = gzip.decompress(raw), 0
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            assert version == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines)
            size = int(fields["Content-Length"])
            block, text = rest[:size], rest[size + 4 :]
            assert rest[size : size + 4] == b"\r\n\r\n"
            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Block-Digest"] == f"sha1:{digest}"
            kinds.append(fields["WARC-Type"])
            count += 1
        members, left = 0, raw
        while left:
            member = zlib.decompressobj(31)
            member.decompress(left)
            left, members = member.unused_data, members + 1
        assert members == count == entry["records"] + 1
    assert kinds.count("response") + kinds.count("revisit") == len(ROWS)


def test_addresses_stay_in_their_line(archives):
    urls = {r["url"] for r in read_archives(archives).where("record_type <> 'warcinfo'").collect()}
    assert "http://a/%C3%BC%20%0D%0AX:%20y%3Cz%3E" in urls and "about:blank" in urls


def test_tasks_roll_over_to_further_archives(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = revisits(pages, "page_id", "url", "html").coalesce(1)
    archives = write_archives(rows, f"file://{tmp_path}/deep/folder")
    assert archives.count() > 2
    assert archives.agg(F.sum("records")).first()[0] == len(ROWS)
    assert read_archives(archives, False).where("record_type <> 'warcinfo'").count() == len(ROWS)


def record(payload=b"text", **changes):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    block = http + payload
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": "<urn:key:1>",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    fields.update({k.replace("_", "-"): v for k, v in changes.items()})
    lines = [f"{n}: {v}" for n, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def cut(data, size):
    return (data[i : i + size] for i in range(0, len(data), size))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(1, 97))
def test_records_from_pieces_of_any_size(payloads, size):
    data = b"".join(gzip.compress(record(p)) for p in payloads)
    assert [r["payload"] for r in records(cut(data, size))] == payloads


def test_large_members_inflate_in_bounded_pieces():
    payload = b"0" * (5 << 20)
    parts = list(inflated(cut(gzip.compress(record(payload)), 1000)))
    assert max(len(p) for p, _ in parts) <= warc.PIECE
    assert sum(e for _, e in parts) == 1
    (row,) = records(cut(gzip.compress(record(payload)), 1000))
    assert row["payload"] == payload


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(record())[:-4],
        gzip.compress(record()) + b"junk",
        gzip.compress(record(Content_Length="9999")),
        gzip.compress(record(Content_Length="3")),
        gzip.compress(record(Content_Length=None)),
        gzip.compress(record(Content_Length="-4")),
        gzip.compress(record(WARC_Payload_Digest="sha1:AAAA")),
        gzip.compress(record()[:-2]),
        gzip.compress(record() + record()),
        gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"),
        gzip.compress(b"WARC/1.0" + b"x" * 100_000),
    ],
)
def test_broken_archives_are_errors(data):
    with pytest.raises(BrokenArchive):
        list(records(cut(data, 7)))


def test_broken_archive_names_its_path(spark, tmp_path):
    path = f"{tmp_path}/bad.warc.gz"
    with open(path, "wb") as out:
        out.write(gzip.compress(record())[:-4])
    table = spark.createDataFrame([(path,)], "path string")
    with pytest.raises(Exception, match="bad.warc.gz: the archive ends inside"):
        read_archives(table).collect()


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert collected(QUERIES["op13_warc_reader"](spark, small)) == plain_rows(rows)
