"""WARC archives as chunked record tables: long payloads are rows of record and chunk number, never whole in memory."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of a chunk of payload; a chunk has at most four times as many bytes.
CHUNK_CHARS = 16_384
#: Payloads of so many bytes and more are written once; equal ones revisit it.
LEAST_BYTES = 0
#: Rows of an output batch.
ROWS = 256
#: Payloads of which one in HOT pages or more is a copy; there are HOT of them at most, and they go to all tasks.
HOT = 4096

CHUNKS = "record_id long, chunk_no int, data binary, payload_sha1 binary"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _name(page_id, digest: str) -> str:
    """The name of a response, which its revisits can tell too."""
    return f"<urn:page:{page_id}:{digest}>"


def _header(record_type: str, record_id: int, page_id, url, block: int, payload: int, digest: str, refers_to, date: str) -> bytes:
    named = record_type == "response" and page_id is not None
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_name(page_id, digest) if named else f'<urn:record:{record_id}>'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload}", f"Content-Length: {block}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: {_name(refers_to, digest)}")
    else:
        lines.append("Content-Type: application/http;msgtype=response")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def _records(batches, chunk: int, date: str):
    """Records in rows of chunks. The first row of a record has its headers alone; the last has its closing line ends."""
    record_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    out: list[tuple] = []
    for batch in batches:
        page, url, html, size, sha1_hex, is_response, refers = (batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "sha1", "is_response", "refers_to"))
        for k in range(batch.num_rows):
            full = is_response[k].as_py()
            n, sha1 = size[k].as_py(), hashlib.sha1()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() if full else b""
            head = _header("response" if full else "revisit", record_id, page[k].as_py(), url[k].as_py(), len(http) + n * full, n, _digest(bytes.fromhex(sha1_hex[k].as_py())), refers[k].as_py(), date)
            out.append((record_id, 0, head + http, sha1.digest()))
            no = 1
            if full and html[k].is_valid:
                whole = html[k].as_buffer()  # a view: the payload is not copied as a whole
                for at in range(0, whole.size, 4 * chunk):
                    part = whole.slice(at, min(4 * chunk, whole.size - at)).to_pybytes()
                    sha1.update(part)
                    out.append((record_id, no, part, sha1.digest()))
                    no += 1
            out.append((record_id, no, b"\r\n\r\n", sha1.digest()))
            record_id += 1
            while len(out) >= ROWS:
                yield _chunk_batch(out[:ROWS])
                del out[:ROWS]
    if out:
        yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    rows = [(record, no, zlib.compress(data, wbits=31), sha1) for record, no, data, sha1 in rows]  # each a gzip member
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "chunk_no", "data", "payload_sha1"])


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES, hot: int = HOT) -> DataFrame:
    """The pages, each with the digest and length of its payload and whether its record is a response or a revisit.

    Of equal payloads of `least_bytes` or more the one with the largest page_id is the response. That page is found
    by a partial maximum for each digest, so that a payload with very many copies is one row for each task before
    the shuffle. Only digests that repeat are joined back. They are written first: those with a large share of all
    pages, `hot` at most, go to all tasks, and their pages to any task by the page; the rest are, by their size, sent to
    the pages (below Spark's broadcast threshold, and no payload moves) or both sides are shuffled on the digest.
    """
    known = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html")
    ).select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("sha1"))
    first = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.table(first.filter("n > 1"), "repeated")
    often = F.col("n") * hot >= pages.count()
    known = known.join(F.broadcast(repeated.filter(often).select("sha1", F.col("first").alias("often"), F.lit(True).alias("is_hot"))), "sha1", "left")
    dealt = known.withColumn("by", F.when(F.col("is_hot"), F.concat_ws("-", F.lit("page"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("sha1")))
    found = dealt.join(repeated.filter(~often).select(F.col("sha1").alias("by"), "first"), "by", "left").withColumn("first", F.coalesce("often", "first"))
    same = F.coalesce(F.col("page_id") == F.col("first"), F.col("page_id").isNull() & F.col("first").isNull())
    return found.select("page_id", "url", "html", "payload_bytes", "sha1", same.alias("is_last"), F.col("first").alias("refers_to")).withColumn(
        "is_response", F.col("refers_to").isNull() | F.col("is_last")
    )


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The archives as a table of chunks in the shared folder; a record's chunks, each a gzip member, are its bytes.

    payload_sha1 is the digest of the record's payload as far as that chunk, so that a reader can check a payload
    that it has read in part. A response with a page_id is named by it and its digest, and revisits refer to that name;
    all records have the time at which the job was made as their date. A null html is an empty payload, a null url leaves the header out, a null page_id too
    (equal payloads of which no page has an id are all responses). Rows that share the largest page_id are all
    responses. An empty table gives an empty archive; other columns are ignored.
    """
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return scratch.table(plan_records(pages, scratch, least_bytes).mapInArrow(lambda batches: _records(batches, chunk_chars, date), CHUNKS), "warc")


class _Reader:
    """One record at a time, fed with its chunks in order; holds a header or the state of a digest, not the payload."""

    def __init__(self):
        self.head, self.fields, self.left, self.http, self.sha1, self.size = b"", None, 0, False, hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            head, end, rest = self.head.partition(b"\r\n\r\n")
            if not end:
                return
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left, self.http = int(self.fields["Content-Length"]), self.fields["WARC-Type"] == "response"
            self.head, data = b"", rest
        data = data[: self.left]
        self.left -= len(data)
        if self.http:  # the HTTP headers end at an empty line
            self.head += data
            _, end, data = self.head.partition(b"\r\n\r\n")
            if not end:
                return
            self.head, self.http = b"", False
        self.sha1.update(data)
        self.size += len(data)

    def row(self, running: bytes) -> tuple:
        f, digest = self.fields, _digest(self.sha1.digest())
        revisit = f["WARC-Type"] == "revisit"
        page, refers, url = f.get("X-Page-ID"), re.search(r"-?\d+", f.get("WARC-Refers-To", "")), f.get("WARC-Target-URI")
        url = url and re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), url)
        intact = self.left == 0 and (revisit or f["WARC-Payload-Digest"] == f"sha1:{digest}" and running == self.sha1.digest())
        told = f["WARC-Payload-Digest"].removeprefix("sha1:")
        size, digest = (int(f["X-Payload-Length"]), told) if revisit else (self.size, digest)
        return int(page) if page else None, url, size, digest, f["WARC-Type"], int(refers[0]) if refers else None, intact


def _parse(batches):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in READ.split(", ")]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    at, reader, running, rows = None, None, b"", []
    for batch in batches:
        for record_id, data, sha1 in zip(*(batch.column(c) for c in ("record_id", "data", "payload_sha1")), strict=True):
            if record_id.as_py() != at:
                if reader:
                    rows.append(reader.row(running))
                at, reader = record_id.as_py(), _Reader()
            reader.feed(zlib.decompress(data.as_py(), wbits=31))
            running = sha1.as_py()
        if len(rows) >= 4096:
            yield make(rows)
            rows = []
    if reader:
        rows.append(reader.row(running))
    if rows:
        yield make(rows)


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record. Chunks are dealt by record and sorted by their number, then parsed as they stream past:
    the digest of a payload is counted anew chunk by chunk, and `intact` says whether it is the one recorded."""
    return chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_parse, READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The op9 columns: pages written as archives and read back."""
    chunks = write_archives(pages, Scratch(pages.sparkSession))
    return read_archives(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"), "intact")
