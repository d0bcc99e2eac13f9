"""FASTQ where it lies: a data source whose partitions are byte ranges, without a shuffle.

A record belongs to the range in which its header line begins. A range that does not begin a file finds the frame of four lines by
itself: a line that begins with ``@`` and has a line with ``+`` two below it is a header, since neither a sequence nor a blank line begins with ``+``, and the
line two below a quality that happens to begin with ``@`` is one of these. The last record is read to its end beyond the range. Gzip files, known
by their first bytes whatever their name, are one range each.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from contigua.model import READS

BLOCK = 4 << 20
FORMAT = "contigua_fastq"
#: ``seq_pos`` is the file's number above this many bits of the record's place in it.
PLACE_BITS = 44


class Range(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int):
        self.number, self.uri, self.start, self.end = number, uri, start, end


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that begin at ``start`` or later."""
    at = max(start - 1, 0)
    if at:
        file.seek(at)
    rest, skip = b"", start > 0  # what stands up to the next line's end belongs to the range before
    while block := file.read(BLOCK):
        rest += block
        *whole, rest_ = rest.split(b"\n")
        for line in whole:
            if not skip:
                yield at, line[:-1] if line.endswith(b"\r") else line
            skip = False
            at += len(line) + 1
        rest = rest_
    if rest and not skip:
        yield at, rest[:-1] if rest.endswith(b"\r") else rest


def records(own: Iterator[tuple[int, bytes]], end: int, inside: bool, name: str) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(place, header, sequence, quality) of the records that begin before ``end``; ``inside``: the first lines may be a record's middle."""
    held: list[tuple[int, bytes]] = []
    for place, line in own:
        if not held and not inside and not line.strip():
            continue
        held.append((place, line))
        if held[0][0] >= end:
            return
        if inside:
            if len(held) == 3 and held[0][1][:1] == b"@" and held[2][1][:1] == b"+":
                inside = False
            elif len(held) == 3:
                del held[0]
            continue
        if len(held) == 4:
            (at, head), (_, sequence), (_, plus), (_, quality) = held
            if head[:1] != b"@" or plus[:1] != b"+":
                raise ValueError(f"{name}: no FASTQ record at {head[:40]!r}")
            yield at, head[1:], sequence, quality
            held = []
    if held and not inside:
        raise ValueError(f"{name}: ends inside a record")


class FastqReader(DataSourceReader):
    def __init__(self, files: list[list], split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[Range]:
        out = []
        for number, (uri, size) in enumerate(self.files):
            with _open(uri) as f:
                zipped = f.read(2) == b"\x1f\x8b"
            step = max(1, size if zipped else self.split)
            out += [Range(number, uri, a, 1 << 62 if zipped else min(a + step, size)) for a in range(0, max(size, 1), step)]
        return out

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READS.split(", ")]
        with _open(own.uri) as raw:
            zipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            file = gzip.open(raw) if zipped else raw
            out: list[tuple] = []
            held = 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.string()] * 4, pa.int64()))], names=names)

            for at, head, sequence, quality in records(lines(file, own.start), own.end, own.start > 0, own.uri):
                name, _, comment = head.decode("utf-8").partition(" ")
                out.append((name, comment, sequence.decode("utf-8"), quality.decode("utf-8"), own.number << PLACE_BITS | at))
                held += len(head) + 2 * len(sequence)
                if held > BLOCK:
                    yield batch()
                    out, held = [], 0
            if out:
                yield batch()


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READS

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(json.loads(self.options["files"]), int(self.options["splitbytes"]))


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that a path, folder or pattern names, in order of name."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(where) or []:
        found += list(fs.listStatus(s.getPath())) if s.isDirectory() else [s]
    files = [s for s in found if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    if not files:
        raise FileNotFoundError(path)
    return sorted((f"file://{s.getPath().toUri().getPath()}" if s.getPath().toUri().getScheme() == "file" else s.getPath().toString(), s.getLen()) for s in files)


def reachable(uri: str) -> bool:
    """Whether executors can open the file without the JVM."""
    try:
        pyarrow.fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame | None:
    """The records of FASTQ files, or none where the files' store is known to the JVM alone."""
    files = listed(spark, path)
    if not all(reachable(uri) for uri, _ in files):
        return None
    spark.dataSource.register(FastqSource)
    size = split_bytes or int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return spark.read.format(FORMAT).option("files", json.dumps(files)).option("splitbytes", size).load()
