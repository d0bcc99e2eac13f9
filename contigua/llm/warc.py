"""WARC archives: a writer with revisit records, and a sequential reader.

Writing: each record is a gzip member of its own. Of records with equal payloads (SHA-1) of at least
``min_revisit`` bytes, that with the largest id is a ``response``; the others are ``revisit`` records that
name it and hold the HTTP headers only. A task writes files under a name of its own and returns their
names; only names returned by successful tasks are in the manifest, so a repeated or lost task
leaves no record twice.

Reading: a file is read in pieces; zlib inflates member by member, headers and Content-Length frame
the record, block and payload digests are checked while the bytes pass. Memory is one piece, and one
record if the payload is asked for. A broken frame or digest raises ``WarcError`` with file and offset.

A payload that very many pages have is told to all tasks, and its records are not brought together.

Files are reached through ``pyarrow.fs``, so the folder may be any URI it knows.

Defined results: a null payload is empty; a null id sorts below all others and is written as an empty
id; rows that repeat an id and payload are equal records; a null or odd URL is percent-escaped; an
empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from contigua.llm.common import cut, shuffle_width, stored

#: Compressed bytes inflated at once; deflate makes at most 1032 bytes of one.
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "<urn:x-page:{}>"
HOT_LEAST, HOT_SHARE = 1000, 10_000


class WarcError(ValueError):
    pass


def base32_sha1(*parts: bytes) -> str:
    h = hashlib.sha1()
    for p in parts:
        h.update(p)
    return base64.b32encode(h.digest()).decode()


def record(kind: str, record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    name = lambda i: RECORD_ID.format("" if i is None else i)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(record_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote((url or "").encode("utf-8", "surrogatepass"), safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(http, body)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(body))),
    ]
    if kind == "revisit":
        head[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload_bytes: int
    payload: bytes | None
    offset: int
    http_bytes: int = field(default=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines if x)}


class _Parser:
    """Takes one member's inflated bytes as they come."""

    def __init__(self, where: str, offset: int, keep: bool):
        self.where, self.offset, self.keep = where, offset, keep
        self.held = bytearray()
        self.headers: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.left = self.http_bytes = self.payload_bytes = 0
        self.block, self.body, self.payload = hashlib.sha1(), hashlib.sha1(), bytearray()

    def fail(self, what: str):
        raise WarcError(f"{self.where} at {self.offset}: {what}")

    def feed(self, data: bytes) -> None:
        self.held += data
        if self.headers is None:
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.held[:end]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                self.fail("no WARC version line")
            self.headers = _fields(lines[1:])
            del self.held[: end + 4]
            if not self.headers.get("content-length", "").isdigit():
                self.fail("no Content-Length")
            self.left = int(self.headers["content-length"])
        if self.http is None:
            end = self.held.find(b"\r\n\r\n", 0, self.left)
            if end < 0:
                if len(self.held) >= self.left:
                    self.fail("no end of the HTTP headers")
                return
            self.http = _fields(bytes(self.held[:end]).split(b"\r\n")[1:])
            self.http_bytes = end + 4
            self.block.update(self.held[: end + 4])
            self.left -= end + 4
            del self.held[: end + 4]
        if self.left and self.held:
            part = bytes(self.held[: self.left])
            del self.held[: len(part)]
            self.left -= len(part)
            self.block.update(part)
            self.body.update(part)
            self.payload_bytes += len(part)
            if self.keep:
                self.payload += part

    def done(self) -> Record:
        if self.headers is None or self.http is None or self.left:
            self.fail("the record is shorter than its Content-Length")
        if self.held != b"\r\n\r\n":
            self.fail("the record does not end where its Content-Length says")
        b32 = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if self.headers.get("warc-block-digest", b32(self.block)) != b32(self.block):
            self.fail("block digest differs")
        if self.headers.get("warc-type") != "revisit" and self.headers.get("warc-payload-digest", b32(self.body)) != b32(self.body):
            self.fail("payload digest differs")
        return Record(self.headers, self.http, self.payload_bytes, bytes(self.payload) if self.keep else None, self.offset, self.http_bytes)


def read_records(stream, where: str = "stream", keep_payload: bool = True) -> Iterator[Record]:
    """The records of a gzip WARC stream, in order."""
    offset, data = 0, stream.read(PIECE)
    while data:
        z, parser = zlib.decompressobj(31), _Parser(where, offset, keep_payload)
        while not z.eof:
            data = data or stream.read(PIECE)
            if not data:
                raise WarcError(f"{where} at {offset}: the file ends inside a member")
            try:
                out = z.decompress(data)
            except zlib.error as e:
                raise WarcError(f"{where} at {offset}: {e}") from e
            offset += len(data) - len(z.unused_data)
            data = z.unused_data
            parser.feed(out)
        yield parser.done()
        data = data or stream.read(PIECE)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, file_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Writes the archives; the manifest (path, records, bytes), computed once."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    light = rows.filter(F.length("payload") >= min_revisit).select("id", "sha1")
    first = stored(light.groupBy(F.col("sha1").alias("of_sha1")).agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("equals")).filter("equals > 1"))
    # Digests of more than one record in HOT_SHARE (so at most HOT_SHARE of them) are told to all tasks; their records stay where they are
    # in the join of the rest, each under a key of its own.
    least = max(HOT_LEAST, first.agg(F.coalesce(F.sum("equals"), F.lit(0))).first()[0] // HOT_SHARE)
    hot = F.broadcast(first.filter(F.col("equals") > least).select(F.col("of_sha1").alias("hot_sha1"), F.col("response").alias("hot_response")))
    rest = first.filter(F.col("equals") <= least).select("of_sha1", "response")
    long_enough = F.length("payload") >= min_revisit
    marked = rows.join(hot, (F.col("sha1") == F.col("hot_sha1")) & long_enough, "left")
    key = F.when(F.col("hot_sha1").isNull() & long_enough, F.col("sha1")).otherwise(F.concat(F.lit("own "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.rand(7).cast("string")))
    ready = marked.withColumn("key", key).join(rest, F.col("key") == F.col("of_sha1"), "left").withColumn("response", F.coalesce("hot_response", "response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        out, name, n, size = None, "", 0, 0
        closed: list[tuple[str, int, int]] = []
        for batch in batches:
            for i, url, payload, sha1, response in zip(*(batch.column(c) for c in range(5))):
                i, payload, response = i.as_py(), payload.as_py(), response.as_py()
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{path}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, n, size = fs.open_output_stream(name, compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                revisit = response is not None and i != response
                z = member(record("revisit" if revisit else "response", i, url.as_py(), payload, digest, response), level)
                out.write(z)
                n, size = n + 1, size + len(z)
                if size >= file_bytes:
                    out.close()
                    closed.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            closed.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(c[0]) for c in closed], pa.string()), pa.array([c[1] for c in closed], pa.int64()), pa.array([c[2] for c in closed], pa.int64())], names=["file", "records", "bytes"])

    return cut(ready.select("id", "url", "payload", "sha1", "response").mapInArrow(write, "file string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row a record: ``id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]``.

    Of a revisit record the payload's size is that which its HTTP headers state; a payload is null.
    """
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload

    def number(uri: str | None) -> int | None:
        text = (uri or "").rpartition(":")[2].rstrip(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * keep_payload)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for r in read_records(stream, file, keep_payload):
                        h = r.headers
                        revisit = h["warc-type"] == "revisit"
                        n = int(r.http_headers.get("content-length", r.payload_bytes)) if revisit else r.payload_bytes
                        row = (number(h["warc-record-id"]), h["warc-target-uri"], n, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")) if revisit else None)
                        rows.append(row + ((None if revisit else r.payload),) * keep_payload)
                        held += r.payload_bytes if keep_payload else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return manifest.select("file").repartition(shuffle_width(spark)).mapInArrow(run, schema)
