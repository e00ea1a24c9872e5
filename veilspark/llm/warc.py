"""WARC archives as chunked record tables.

`write_records` turns pages into WARC/1.1 records and stores them as rows
(archive, seq, record_id, chunk, last, data): the data of an archive's rows, in order
of (seq, chunk), are the bytes of a valid WARC file. A payload over `chunk_bytes` takes
several rows, so no row and no buffer ever holds an oversized record; digests are
carried from chunk to chunk. `read_records` parses the table back: records of one row
where they lie, oversized ones by streaming their rows in order. `export_files` writes
`.warc.gz` files, a gzip member for each record, and `scan_file` reads one.

The table goes through Spark's own writer and reader, so it may lie in any store that
Spark reaches. A record names its payload's SHA-1; pages with equal payloads (of
`min_revisit_bytes` or more) become revisits of the one with the smallest page_id.

Defined results: null html is an empty payload; null urls are empty; white space and
control characters in a url are percent-encoded. Null page_ids come after all others.
Rows that repeat the smallest page_id of a payload are each a response. Rows that
repeat another page_id are each a revisit. Columns of `pages` other than the three are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 64 * 1024
#: Bytes of data that are handed to Spark at a time.
FLUSH_BYTES = 4 * 1024 * 1024
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
TABLE = "archive int, seq long, record_id string, chunk int, last boolean, data binary"
RECORD = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of the SHA-1 of a binary column, by built-in functions: five hex digits give four letters."""
    digits = F.sha1(payload)
    parts = []
    for k in range(8):
        n = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat the payload of one with a smaller page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    each = pages.select("page_id", base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= min_revisit_bytes).select("page_id", "digest")
    # written, so that both sides of the join are plain shuffles, which Spark can split where one digest holds many rows
    first = common.materialize(each.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    return each.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def head(page_id: int | None, url: str, digest: str, size: int, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Record id and header block; for responses with the HTTP header that leads the payload."""
    name = record_id(page_id, digest)
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    http = b""
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + size * (refers_to is None)}")
    return name, "\r\n".join(lines).encode() + END + http


def chunks(page_id: int | None, url: str, payload: memoryview, refers_to: int | None, chunk_bytes: int, date: str) -> Iterator[tuple[str, int, bool, bytes]]:
    """(record id, chunk number, whether it is the last, data) of one record."""
    digest = hashlib.sha1()
    for at in range(0, len(payload), chunk_bytes):
        digest.update(payload[at : at + chunk_bytes])
    name, top = head(page_id, url, base64.b32encode(digest.digest()).decode(), len(payload), refers_to, date)
    if refers_to is not None:
        payload = payload[:0]
    last = max(0, -(-len(payload) // chunk_bytes) - 1)
    for k in range(last + 1):
        part = payload[k * chunk_bytes : (k + 1) * chunk_bytes]
        yield name, k, k == last, b"".join((top if k == 0 else b"", part, END if k == last else b""))


def write_records(pages: DataFrame, name: str = "warc", *, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """The chunked record table of `pages` (page_id, url, html), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0
        fields = pa.schema([("archive", pa.int32()), ("seq", pa.int64()), ("record_id", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())])
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
        for batch in batches:
            ids, urls, payloads, refers = (batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))
            for i in range(batch.num_rows):
                payload = payloads[i].as_buffer()
                for part in chunks(ids[i].as_py(), urls[i].as_py(), memoryview(payload), refers[i].as_py(), chunk_bytes, date):
                    rows.append((archive, seq, *part))
                    held += len(part[-1])
                    if held >= FLUSH_BYTES:
                        yield pack()
                        rows, held = [], 0
                seq += 1
        if rows:
            yield pack()

    payload = F.coalesce("html", F.lit("")).cast("binary")
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    again = revisits(pages, min_revisit_bytes).select(F.col("page_id").cast("long").alias("of"), "digest", F.col("refers_to").cast("long").alias("refers_to"))
    known = base32_sha1(F.col("payload"))
    joined = each.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (known == F.col("digest")), "left")
    return common.materialize(joined.select("page_id", "url", "payload", "refers_to").mapInArrow(run, TABLE), name)


class Reader:
    """One record, chunk by chunk: headers, then a running digest of the payload."""

    def __init__(self):
        self.top, self.fields, self.size, self.digest, self.left = bytearray(), None, 0, hashlib.sha1(), 0

    def feed(self, data: bytes | memoryview) -> None:
        if self.fields is None:
            self.top += data
            cut = self.top.find(END)
            if cut < 0:
                return
            response = b"\r\nWARC-Type: response\r\n" in self.top[: cut + 2]
            body = self.top.find(END, cut + 4) if response else cut
            if body < 0:
                return
            lines = self.top[:cut].decode("utf-8").split("\r\n")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"]) - (body - cut if response else 0)
            data = memoryview(bytes(self.top))[body + 4 :]
            self.top = bytearray()
        part = memoryview(data)[: self.left]
        self.digest.update(part)
        self.size += len(part)
        self.left -= len(part)

    def row(self) -> tuple:
        f = self.fields or {}
        number = lambda k: int(f[k]) if k in f else None
        said, kind = f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), f.get("WARC-Type")
        if kind == "revisit":
            return number("X-Page-ID"), f.get("WARC-Record-ID"), f.get("WARC-Target-URI"), kind, number("X-Payload-Length"), said, number("X-Refers-To-Page-ID"), self.left == 0
        found = base64.b32encode(self.digest.digest()).decode()
        return number("X-Page-ID"), f.get("WARC-Record-ID"), f.get("WARC-Target-URI"), kind, self.size, found, None, self.left == 0 and found == said


_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)


def read_records(table: DataFrame) -> DataFrame:
    """The records of a chunked record table: RECORD. `intact`: length and digest are as the header says.

    Payload length and digest of responses are of the bytes read; a revisit's are those its header names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, rows = None, None, []
        for batch in batches:
            archives, seqs, data = batch.column("archive").to_pylist(), batch.column("seq").to_pylist(), batch.column("data")
            for i, here in enumerate(zip(archives, seqs, strict=True)):
                if here != at:
                    if reader:
                        rows.append(reader.row())
                    at, reader = here, Reader()
                reader.feed(memoryview(data[i].as_buffer()))
            if len(rows) >= 4096:
                yield _records(rows)
                rows = []
        if reader:
            rows.append(reader.row())
        if rows:
            yield _records(rows)

    parts = table.select("archive", "seq", "chunk", "last", "data")
    whole = parts.where("chunk = 0 and last").mapInArrow(run, RECORD)
    key = ("archive", "seq")
    rest = parts.where("not (chunk = 0 and last)").repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(run, RECORD)
    return whole.unionByName(rest)


def export_files(table: DataFrame, folder: str) -> list[str]:
    """Writes archive-NNNNN.warc.gz for each archive into `folder`, which all executors must see as a local path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, made = (None, None), None, []
        for batch in batches:
            for archive, seq, last, data in zip(*(batch.column(c) for c in ("archive", "seq", "last", "data")), strict=True):
                if archive.as_py() != at[0]:
                    made.append(os.path.join(folder, f"archive-{archive.as_py():05d}.warc.gz"))
                    open(made[-1], "wb").close()
                if (archive.as_py(), seq.as_py()) != at:
                    at = archive.as_py(), seq.as_py()
                    out = gzip.GzipFile(made[-1], "ab", mtime=0)
                out.write(memoryview(data.as_buffer()))
                if last.as_py():
                    out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made)], ["path"])

    os.makedirs(folder, exist_ok=True)
    rows = table.repartition("archive").sortWithinPartitions("archive", "seq", "chunk").mapInArrow(run, "path string").collect()
    return sorted(r.path for r in rows)


def scan_file(path: str) -> Iterator[tuple]:
    """The records of a `.warc.gz` file, as rows of RECORD, read in pieces of 64 KiB."""
    with gzip.open(path, "rb") as f:
        while line := f.readline():
            reader, top = Reader(), bytearray(line)
            while not top.endswith(END):
                top += f.readline()
            left = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", top)[1])
            reader.feed(bytes(top))
            while left:
                part = f.read(min(left, 65536))
                left -= len(part)
                reader.feed(part)
            f.read(len(END))
            yield reader.row()
