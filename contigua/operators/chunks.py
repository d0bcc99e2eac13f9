"""Sequences in chunks: records of any length, a chromosome too, over many tasks.

A chunk is (header, chunk, offset, bases): ``bases`` from ``offset``, a multiple of the chunk's size. What goes on over a chunk's edge (a run
of N, a homopolymer) is joined through summaries of a row a chunk: only the first and last run of a chunk can be part of a longer one, so only
these are brought together, and runs inside stay where they were found. Lines of a FASTA file end at edges, as sizes are multiples of their width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from contigua.model import GAP, SEGMENT
from contigua.operators.lineage import Rounds

SIZE = 60 * (1 << 14)

#: Letters in which runs are looked for at once, be they of one chunk or of many.
_HELD = 1 << 18
_GAP_LETTERS = np.frombuffer("NnXx".encode("utf-32-le"), np.uint32)
COUNTS = ("a", "c", "g", "t", "lower")


def from_records(records: DataFrame, size: int = SIZE, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """Records that are rows already, cut; an empty one has an empty chunk."""
    rows = records.select(F.col(header).cast("string").alias("header"), F.coalesce(sequence, F.lit("")).alias("s"))
    rows = rows.select("header", "s", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("s") - 1, F.lit(0)), F.lit(size))).alias("chunk", "offset"))
    return rows.select("header", F.col("chunk").cast("long").alias("chunk"), F.col("offset").cast("long").alias("offset"), F.expr(f"substring(s, offset + 1, {size})").alias("bases"))


# -- reading ----------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str, size: int = SIZE, whole: bool = False) -> DataFrame:
    """(header, comment, place, chunk, offset, bases) of FASTA files, read in Spark's own splits; ``place`` orders the records. ``whole``: the files are
    parts of one text in order of their names, as ``write_fasta`` leaves them; else a record ends with its file.

    Each split knows how many bases it has before its first header; the open record and the offset there are carried over splits by a window over a
    row a split.
    """
    store = Rounds(spark, keep=1 << 30)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["file", "block", "record", "header", "comment", "at", "bases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        where, record, header, comment, at, held, size_ = None, 0, None, None, 0, [], 0

        def piece() -> None:
            nonlocal at, held, size_
            out.append((*where, record, header, comment, at, "".join(held)))
            at, held, size_ = at + size_, [], 0

        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != where:
                    if where is not None:
                        piece()
                    where, record, header, comment, at = (file, block), 0, None, None, 0
                if value.startswith(">"):
                    piece()
                    name, _, rest = value[1:].rstrip("\r").partition(" ")
                    record, header, comment, at = record + 1, name, rest, 0
                    continue
                held.append(value.rstrip("\r"))
                size_ += len(held[-1])
                if size_ >= size:
                    piece()
            if len(out) > 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if where is not None:
            piece()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    pieces = store.write(text.mapInArrow(run, "file string, block long, record long, header string, comment string, at long, bases string"))
    lengths = pieces.groupBy("file", "block", "record").agg(F.sum(F.length("bases")).alias("n"), F.max("header").alias("header"), F.max("comment").alias("comment"))
    splits = lengths.groupBy("file", "block").agg(
        F.coalesce(F.sum(F.when(F.col("record") == 0, F.col("n"))), F.lit(0)).alias("head"), F.max("record").alias("records"),
        F.max(F.when(F.col("record") > 0, F.struct("record", "n", "header", "comment"))).alias("last"),
    )
    order = Window.partitionBy(F.lit(0) if whole else F.col("file")).orderBy("file", "block")  # a row a split
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("upto", F.coalesce(F.sum("head").over(earlier), F.lit(0)))
    open_ = F.when(F.col("records") > 0, F.struct("file", "block", F.col("last.record").alias("record"), F.col("last.header").alias("header"), F.col("last.comment").alias("comment"), (F.col("last.n") - F.col("upto") - F.col("head")).alias("less")))
    carried = splits.withColumn("open", F.last(open_, ignorenulls=True).over(earlier)).filter("open IS NOT NULL")
    carried = carried.select("file", "block", F.lit(0).cast("long").alias("record"), F.col("open.header").alias("o_header"), F.col("open.comment").alias("o_comment"), F.col("open.file").alias("o_file"), F.col("open.block").alias("o_block"), F.col("open.record").alias("o_record"), (F.col("upto") + F.col("open.less")).alias("before"))
    placed = pieces.join(carried, ["file", "block", "record"], "left").filter("record > 0 OR o_header IS NOT NULL")
    placed = placed.select(
        F.coalesce("o_header", "header").alias("header"), F.coalesce("o_comment", "comment").alias("comment"),
        F.struct(F.coalesce("o_file", "file").alias("file"), F.coalesce("o_block", "block").alias("block"), F.coalesce("o_record", "record").alias("record")).alias("place"),
        (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "bases",
    )
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.greatest(F.length("bases"), F.lit(1)) - 1) / size)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * size, F.col("at"))
    part = F.substring("bases", (begin - F.col("at") + 1).cast("int"), ((F.col("chunk") + 1) * size - begin).cast("int"))
    cut = cut.select("header", "comment", "place", "chunk", F.struct(begin.alias("b"), part.alias("s")).alias("p"))
    whole = cut.groupBy("header", "comment", "place", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("bases"))  # a chunk's pieces
    whole = whole.filter("bases <> '' OR chunk = 0")
    return whole.select("header", "comment", "place", "chunk", (F.col("chunk") * size).alias("offset"), "bases")


def fasta_blocks(chunks: DataFrame, width: int = 60, size: int = SIZE) -> DataFrame:
    """``chunks`` with ``line``: the chunk's part of a FASTA file, lines of ``width`` joined by line ends, before the first the header line."""
    if size % width:
        raise ValueError("chunks must be whole lines")
    body = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    title = F.concat(F.lit(">"), "header", F.when(F.col("comment") != "", F.concat(F.lit(" "), "comment")).otherwise("")) if "comment" in chunks.columns else F.concat(F.lit(">"), "header")
    return chunks.withColumn("line", F.when(F.col("chunk") == 0, F.concat(title, F.when(F.col("bases") != "", F.concat(F.lit("\n"), body)).otherwise(""))).otherwise(body))


def write_fasta(chunks: DataFrame, path: str, width: int = 60, size: int = SIZE) -> None:
    """In order of ``place`` (or header) and chunk, over many files whose names are in order."""
    by = ["place" if "place" in chunks.columns else "header", "chunk"]
    rows = fasta_blocks(chunks, width, size)
    spread = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(spread, *by).sortWithinPartitions(*by).select("line").write.text(path)


# -- runs over edges ----------------------------------------------------------------------------------


def _runs(chunks: DataFrame, labels: Callable[[np.ndarray], np.ndarray], figures: Callable[[np.ndarray, np.ndarray], list[np.ndarray]] | None = None, least: int = 1) -> DataFrame:
    """(header, number, label, start, end, figures): maximal stretches of letters of one label, numbered along the record from 0.

    Inner runs shorter than ``least`` are left out; with ``least`` above 1 numbers still count them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column("bases")).to_numpy()
            group = np.cumsum(sizes) // _HELD
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found = runs_of(batch.slice(a, e - a).filter(pa.array(sizes[a:e] > 0)))
                if found is not None:
                    yield found

    def runs_of(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """The runs of chunks that have letters, looked for behind one another, as in one text."""
        if not rows.num_rows:
            return None
        texts = rows.column("bases").to_pylist()
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        label = labels(letters)
        edge = np.diff(label, prepend=np.int64(-1)) != 0
        edge[begin] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(label))
        own = np.stack(figures(letters, starts), 1) if figures else np.zeros((len(starts), 0), np.int64)
        first = np.searchsorted(starts, begin)
        n = np.diff(np.append(first, len(starts)))
        chunk = np.repeat(np.arange(len(texts)), n)
        r = np.arange(len(starts)) - first[chunk]
        at = np.flatnonzero((ends - starts >= least) | (r == 0) | (r == n[chunk] - 1))
        shift = (rows.column("offset").to_numpy() - begin)[chunk[at]]
        bounds = pa.array(np.append(0, np.cumsum(np.bincount(chunk[at], minlength=len(texts)))).astype(np.int32))
        listed = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (r[at], label[starts[at]], starts[at] + shift, ends[at] + shift)]
        width = own.shape[1]
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(at) + 1, width, dtype=np.int32) if width else np.zeros(len(at) + 1, np.int32)), pa.array(own[at].ravel().astype(np.int64)))
        columns = [rows.column("header"), rows.column("chunk"), pa.array(n), *listed, pa.ListArray.from_arrays(bounds, each)]
        return pa.RecordBatch.from_arrays(columns, names=["header", "chunk", "n", "r", "label", "start", "end", "figures"])

    store = Rounds(chunks.sparkSession, keep=1 << 30)
    found = store.write(chunks.select("header", "chunk", "offset", "bases").mapInArrow(run, "header string, chunk long, n long, r array<long>, label array<long>, start array<long>, end array<long>, figures array<array<long>>"))
    summary = found.select("header", "chunk", "n", F.element_at("label", 1).alias("first"), F.element_at("label", -1).alias("last"))
    order = Window.partitionBy("header").orderBy("chunk")
    joins = F.when(F.col("first") == F.lag("last").over(order), 1).otherwise(0)
    summary = summary.withColumn("joins", joins)
    base = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("joins").over(order)
    numbered = found.join(summary.select("header", "chunk", base.alias("base")), ["header", "chunk"])
    rows = numbered.select("header", "n", "base", F.explode(F.arrays_zip("r", "label", "start", "end", "figures")).alias("x")).select("header", "n", (F.col("base") + F.col("x.r")).alias("number"), "x.*")
    edge = (F.col("r") == 0) | (F.col("r") == F.col("n") - 1)
    columns = ["header", "number", "label", "start", "end", "figures"]
    width = len(figures(np.zeros(1, np.uint32), np.zeros(1, np.int64))) if figures else 0
    total = F.array(*(F.sum(F.element_at("figures", i + 1)) for i in range(width))) if width else F.expr("cast(array() as array<bigint>)")
    over = rows.filter(edge).groupBy("header", "number").agg(F.min("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), total.alias("figures"))
    return rows.filter(~edge).select(*columns).unionByName(over.select(*columns))


def features(chunks: DataFrame) -> DataFrame:
    """(header, i, name, kind, start, end, len, a, c, g, t, lower): the segments and gaps of ``ingest.features`` by their places, with the
    bases of each counted where they lie."""
    letter = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    classes = [letter(x) for x in ("Aa", "Cc", "Gg", "Tt")]

    def figures(letters: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        sums = [np.add.reduceat(((letters == c[0]) | (letters == c[1])).astype(np.int64), starts) for c in classes]
        lower = (letters >= ord("a")) & (letters <= ord("z"))
        return [*sums, np.add.reduceat(lower.astype(np.int64), starts)]

    rows = _runs(chunks, lambda x: np.isin(x, _GAP_LETTERS).astype(np.int64), figures)
    kind = F.when(F.col("label") == 1, GAP).otherwise(SEGMENT)
    counts = [F.element_at("figures", i + 1).alias(c) for i, c in enumerate(COUNTS)]
    i = F.col("number") + 1
    return rows.select("header", i.alias("i"), F.concat_ws(".", "header", i.cast("string")).alias("name"), kind.alias("kind"), "start", "end", (F.col("end") - F.col("start")).alias("len"), *counts)


def homopolymer_bed(chunks: DataFrame, cutoff: int = 1) -> DataFrame:
    """(header, start, end) of runs of more than ``cutoff`` equal letters, over edges too."""
    return _runs(chunks, lambda x: x.astype(np.int64), least=cutoff + 1).filter(F.col("end") - F.col("start") > cutoff).select("header", "start", "end")
