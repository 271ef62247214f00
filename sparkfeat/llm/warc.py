"""WARC archives: written by the tasks that hold the pages, read back record by record.

Every record is a gzip member of its own. The reader passes an archive once from front to back:
it inflates bounded pieces, finds the end of a record's header, takes as many bytes as the
header's Content-Length says, and checks what it took against the digests. Archives lie in a
shared folder under names that no other attempt of a task uses; a stored list names those of the
tasks that ended, so what a lost task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm.batches import one_thread
from sparkfeat.operators.joins import join_counted
from sparkfeat.sources.store import materialize, scratch_path

#: Equal payloads below this many bytes are all stored.
LEAST_BYTES = 1000
#: Compressed bytes from which the next record opens another archive of the task.
ARCHIVE_BYTES = 256 << 20
#: Bytes that are read, deflated or inflated at once.
PIECE = 1 << 20
#: Bytes that a record's header may have.
HEADER = 1 << 16
#: Records, or bytes of payload, that leave a task at once.
ROWS, BATCH_BYTES = 4096, 4 << 20

VERSION = b"WARC/1.1"
KEY_URN = "urn:key:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F))).replace("<", "").replace(">", "")


# --- deciding what is stored ----------------------------------------------------------------


def revisits(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """Pages as ``key``, ``url``, ``payload``, ``digest``, ``is_revisit`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the one with the largest key is a response and
    the others revisit it. Rows that share the largest key are all responses, and so are rows of
    a payload without any key; a row whose key is missing revisits one that has a key. A missing
    payload is empty. Hot payloads are dealt out to many tasks.
    """
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "same": F.sha2("payload", 256)})
    shared = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("same")
        .agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )
    joined = join_counted(rows, shared, "same", "rows")
    other = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select(
        "key", "url", "payload", "digest", other.alias("is_revisit"), F.when(other, F.col("last")).alias("refers_to")
    )


# --- writing --------------------------------------------------------------------------------


def _sha1_field(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _urn(key) -> str:
    return f"<{KEY_URN}{'' if key is None else quote(str(key), safe='')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"\r\n".join([VERSION, *(f"{n}: {v}".encode() for n, v in fields)]) + b"\r\n\r\n"


def _page_record(row: dict, date: str) -> list[bytes]:
    """The bytes of a page's record: WARC header, HTTP header and, of a response, the payload."""
    payload = row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = [http.encode()] if row["is_revisit"] else [http.encode(), payload]
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    fields = [
        ("WARC-Type", "revisit" if row["is_revisit"] else "response"),
        ("WARC-Record-ID", _urn(row["key"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(row["url"], safe=_PRINTABLE) if row["url"] else "about:blank"),
        ("WARC-Payload-Digest", _sha1_field(bytes.fromhex(row["digest"]))),
        ("WARC-Block-Digest", _sha1_field(digest.digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", sum(map(len, block))),
    ]
    if row["is_revisit"]:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _urn(row["refers_to"]))]
    return [_head(fields), *block, b"\r\n\r\n"]


def _info_record(date: str) -> list[bytes]:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Block-Digest", _sha1_field(hashlib.sha1(block).digest())),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return [_head(fields), block, b"\r\n\r\n"]


def _put(out, record: list[bytes]) -> int:
    """Write a record as one gzip member; the number of compressed bytes."""
    member = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    size = 0
    for part in record:
        for start in range(0, len(part), PIECE):
            size += out.write(member.compress(memoryview(part)[start : start + PIECE]))
    return size + out.write(member.flush())


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write rows of :func:`revisits` as archives into a shared folder; the stored list of them.

    The list has ``path``, ``records`` (without the first, which describes the archive) and
    ``bytes``. A task without rows writes none. The record's id is made of the key, so repeated
    rows have records of one id. A missing address is ``about:blank``; characters that a header
    cannot hold are percent-encoded.
    """

    def write(batches):
        one_thread()
        store, path = fs.FileSystem.from_uri(folder)
        out, name, records, size = None, "", 0, 0

        def done():
            out.close()
            columns = [[name], [records], [size]]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["path", "records", "bytes"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if out is None:
                    store.create_dir(path, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    name, records = f"{folder}/{file}", 0
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                    size = _put(out, _info_record(date))
                size += _put(out, _page_record(row, date))
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


# --- reading --------------------------------------------------------------------------------


class BrokenArchive(ValueError):
    """An archive that does not follow its own framing."""


def inflated(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether the gzip member ends with them) of an archive given in pieces."""
    member, left = None, b""
    for piece in pieces:
        left = piece
        while left:
            if member is None:
                member = zlib.decompressobj(16 + zlib.MAX_WBITS)
            try:
                out = member.decompress(left, PIECE)
            except zlib.error as wrong:
                raise BrokenArchive(f"not a gzip member: {wrong}") from wrong
            left = member.unused_data if member.eof else member.unconsumed_tail
            while not member.eof and not left and len(out) == PIECE:
                yield out, False
                out = member.decompress(b"", PIECE)
                left = member.unused_data if member.eof else member.unconsumed_tail
            yield out, member.eof
            if member.eof:
                member = None
    if member is not None:
        raise BrokenArchive("the archive ends inside a gzip member")


class _Record:
    """One record while its bytes pass."""

    def __init__(self, with_payload: bool):
        self.head, self.fields = b"", None
        self.with_payload, self.payload = with_payload, []
        self.block, self.body, self.http = hashlib.sha1(), hashlib.sha1(), b""
        self.payload_bytes, self.is_http, self.in_body = 0, False, False
        self.left, self.tail = 0, b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                if len(self.head) > HEADER:
                    raise BrokenArchive("a record's header does not end")
                return
            data, self.head = self.head[end + 4 :], self.head[:end]
            self._open()
        taken = data[: self.left]
        self.left -= len(taken)
        if taken:
            self._take(taken)
        self.tail += data[len(taken) :]
        if len(self.tail) > 4:
            raise BrokenArchive("a record is longer than its Content-Length")

    def _open(self) -> None:
        version, *lines = self.head.decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise BrokenArchive(f"a record starts with {version[:20]!r}")
        pairs = (line.partition(":") for line in lines)
        self.fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
        length = self.fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise BrokenArchive("a record has no Content-Length")
        self.left = int(length)
        self.is_http = self.fields.get("content-type", "").startswith("application/http")
        self.in_body = not self.is_http

    def _take(self, data: bytes) -> None:
        self.block.update(data)
        if not self.in_body:
            self.http += data
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            data, self.http = self.http[end + 4 :], self.http[:end]
            self.in_body = True
        self.body.update(data)
        self.payload_bytes += len(data)
        if self.with_payload:
            self.payload.append(data)

    def _declared_bytes(self) -> int:
        for line in self.http.decode("latin-1").split("\r\n"):
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length":
                return int(value)
        raise BrokenArchive("a revisit does not say how long its payload was")

    def close(self) -> dict:
        """The record's row; its framing and its digests must hold."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise BrokenArchive("a record ends before its Content-Length, or without its last lines")
        kind = self.fields.get("warc-type", "")
        digests = {"warc-block-digest": self.block}
        if kind != "revisit":
            digests["warc-payload-digest"] = self.body
        for name, found in digests.items():
            if name in self.fields and self.fields[name] != _sha1_field(found.digest()):
                raise BrokenArchive(f"{name} of {self.fields.get('warc-record-id')} does not hold")
        payload = self.body.hexdigest()
        if (stated := self.fields.get("warc-payload-digest", "")).startswith("sha1:"):
            payload = base64.b32decode(stated[5:]).hex()
        return {
            "record_type": kind,
            "record_id": self.fields.get("warc-record-id"),
            "refers_to_id": self.fields.get("warc-refers-to"),
            "url": self.fields.get("warc-target-uri"),
            "date": self.fields.get("warc-date"),
            "payload_bytes": self._declared_bytes() if kind == "revisit" else self.payload_bytes,
            "payload_digest": payload,
            "payload": b"".join(self.payload) if self.with_payload and kind != "revisit" else None,
        }


def records(pieces: Iterator[bytes], with_payload: bool = True) -> Iterator[dict]:
    """The records of an archive given in pieces, one by one."""
    record = None
    for data, ends in inflated(pieces):
        record = record or _Record(with_payload)
        record.feed(data)
        if ends:
            yield record.close()
            record = None


ROW = pa.schema(
    [
        ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
        ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
ROW_DDL = (
    "record_type string, record_id string, refers_to_id string, url string, date string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that a table lists by ``path``, a task for some archives.

    Returns ``record_type``, ``record_id``, ``refers_to_id``, ``url``, ``date``, ``payload_bytes``
    and ``payload_digest`` (SHA-1 in hex; both of the full payload, of a revisit as stated in its
    headers) and ``payload``, missing of revisits and without ``with_payload``. A record that
    ends too early or too late, or whose digests do not hold, stops the job: see
    :class:`BrokenArchive`. Missing paths are left out; an empty table gives no rows; an archive
    that is listed twice is read twice.
    """

    def pieces(path: str) -> Iterator[bytes]:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as stream:
            while piece := stream.read(PIECE):
                yield piece

    def read(batches):
        one_thread()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                try:
                    for row in records(pieces(path), with_payload):
                        held.append(row)
                        size += len(row["payload"] or b"")
                        if len(held) >= ROWS or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, ROW)
                            held, size = [], 0
                except BrokenArchive as wrong:
                    raise BrokenArchive(f"{path}: {wrong}") from wrong
                yield pa.RecordBatch.from_pylist(held, ROW)

    return archives.where("path IS NOT NULL").select("path").mapInArrow(read, ROW_DDL)


def key_of(record_id: str):
    """The key that a record's id was made of, as text; NULL for a missing key."""
    inner = F.regexp_extract(record_id, f"^<{KEY_URN}(.*)>$", 1)
    return F.nullif(F.url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), F.lit(""))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` (``page_id``, ``url``, ``html``), read the archives back, and report.

    One row per page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``
    (response or revisit), ``refers_to`` (the response's page) and ``url`` as archived. For
    missing values and repeated rows see :func:`revisits`; other columns play no part; an empty
    table gives no rows.
    """
    kind = pages.schema["page_id"].dataType
    rows = revisits(pages, "page_id", "url", "html")
    archives = write_archives(rows, folder or scratch_path(spark, "warc"))
    found = read_archives(archives, with_payload=False).where("record_type <> 'warcinfo'")
    return found.select(
        key_of("record_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        key_of("refers_to_id").cast(kind).alias("refers_to"),
        "url",
    )
