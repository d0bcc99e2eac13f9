"""Readers of FASTA, FASTQ, GFA 1 and 2, AGP, BED and k-mer inputs as DataFrames.

Text is read by Spark's own source, so any store and codec that Hadoop knows works (.gz by its name). Records
that span lines are read with a record delimiter where the format has one; FASTQ, which has none, has a source of its own
(``fastq``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contigua.model import AGP, BED, COMPONENTS, EDGE, GAP, READS, SEGMENT, Assembly
from contigua.operators import filters, ingest
from contigua.operators.lineage import shared_root
from contigua.operators.paths import renumber, revcom, trim
from contigua.sources import fastq

TAB = "\t"


def sniff(spark: SparkSession, path: str) -> str:
    """``fasta``, ``fastq`` or ``gfa`` by the first character of the first line."""
    first = spark.read.text(path).filter("value <> ''").limit(1).collect()
    start = first[0].value[:1] if first else ""
    return {">": "fasta", "@": "fastq"}.get(start, "gfa")


def is_gzip(spark: SparkSession, path: str) -> DataFrame:
    """(path, gzip) by the first two bytes of each file; no more of it is read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.globStatus(where) or []]
    files = [f.getPath() for s in files for f in (fs.listStatus(s) if fs.getFileStatus(s).isDirectory() else [fs.getFileStatus(s)]) if f.isFile() and not f.getPath().getName().startswith((".", "_"))]
    found = []
    for f in files:
        stream = fs.open(f)
        try:
            found.append((f.toString(), stream.read() == 0x1F and stream.read() == 0x8B))
        finally:
            stream.close()
    return spark.createDataFrame(found, "path string, gzip boolean")


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of files below 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, comment, sequence, quality, seq_pos). ``>`` inside a header line stays part of the record: a
    record begins at ``>`` after a line's end."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("seq_pos", F.monotonically_increasing_id())
    text = F.regexp_replace("value", "^>", "")
    head, body = F.substring_index(text, "\n", 1), F.regexp_replace(F.expr("substring(t, instr(t, '\n') + 1, length(t))"), r"[\r\n]", "")
    parts = rows.filter(F.trim("value") != "").withColumn("t", text).withColumn("h", F.regexp_replace(head, "\r$", ""))
    body = F.when(F.instr("t", "\n") > 0, body).otherwise("")
    return parts.select(F.substring_index("h", " ", 1).alias("header"), F.when(F.instr("h", " ") > 0, F.regexp_replace("h", "^[^ ]* ", "")).otherwise("").alias("comment"), body.alias("sequence"), F.lit(None).cast("string").alias("quality"), "seq_pos")


def read_fastq(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(header, comment, sequence, quality, seq_pos): groups of four lines, read in ranges of ``split_bytes`` (by default Spark's own)
    where they lie. Where a store is known to the JVM alone, lines come from Spark's text source instead, and a file is one task's."""
    own = fastq.read(spark, path, split_bytes)
    return own if own is not None else _fastq_by_file(spark, path)


def _fastq_by_file(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        file = None
        for batch in batches:
            out = []
            for value, own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if own != file:
                    if held:
                        raise ValueError(f"{file}: ends inside a record")
                    file = own
                if not held and not value.strip():
                    continue
                held.append(value.rstrip("\r"))
                if len(held) == 4:
                    head, seq, plus, quality = held
                    if head[:1] != "@" or plus[:1] != "+":
                        raise ValueError(f"{file}: no FASTQ record at {head[:40]!r}")
                    name, _, comment = head[1:].partition(" ")
                    out.append((name, comment, seq, quality, n))
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (*[pa.string()] * 4, pa.int64()))], names=["header", "comment", "sequence", "quality", "seq_pos"])
        if held:
            raise ValueError(f"{file}: ends inside a record")

    return ordered.mapInArrow(run, READS)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return {"fasta": read_fasta, "fastq": read_fastq}[sniff(spark, path)](spark, path)


# -- GFA --------------------------------------------------------------------------------------------


def tags_of(fields: Column) -> Column:
    """``label:type:content`` fields as structs; others are not tags."""
    own = F.filter(fields, lambda f: f.rlike("^[A-Za-z][A-Za-z0-9]:[AifZJHB]:"))
    return F.transform(own, lambda f: F.struct(F.substring(f, 1, 2).alias("label"), F.substring(f, 4, 1).alias("type"), F.regexp_replace(f, "^.....", "").alias("content")))


def _col(i: int) -> Column:
    return F.try_element_at("f", F.lit(i + 1))


def _rest(i: int) -> Column:
    return F.when(F.size("f") > i, F.slice("f", i + 1, F.size("f"))).otherwise(F.expr("cast(array() as array<string>)"))


def _tag(tags: Column, label: str) -> Column:
    return F.try_element_at(F.transform(F.filter(tags, lambda t: t["label"] == label), lambda t: t["content"]), F.lit(1))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """Rows without a name get ``prefix`` and their number, in order of appearance among such rows.

    ``n`` holds the task that read a row above its number there, so a row's number is that among its task's, and the rows of the tasks before it.
    """
    none = df.filter("header IS NULL").withColumn("__task", F.shiftright("n", 33))
    held = none.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    ranked = none.join(held.select("__task", before.alias("__before")), "__task")
    number = F.row_number().over(Window.partitionBy("__task").orderBy("n")) - 1 + F.col("__before")
    named = ranked.withColumn("header", F.concat(F.lit(prefix), number.cast("string"))).select(*df.columns)
    return df.filter("header IS NOT NULL").unionByName(named)


KINDS = ("H", "S", "J", "L", "P", "G", "E", "O")


def _write_by_kind(lines: DataFrame, folder: str) -> None:
    """A task keeps a file open for each kind, so that it need not sort its lines by kind."""
    conf, key = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, None)
    conf.set(key, str(max(len(KINDS), int(before or 0))))
    try:
        lines.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def read_gfa(spark: SparkSession, path: str) -> Assembly:
    """The assembly of a GFA 1 or 2 file; the version is that of the header, or told by the kinds of lines.

    The text is read once, and its lines are written to the shared folder by kind; each table is made of those of its kind.
    """
    text = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", "\r$", "")).withColumn("kind", F.substring_index("value", TAB, 1))
    folder = f"{shared_root(spark)}/gfa-{uuid.uuid4().hex}"
    _write_by_kind(text.filter(F.col("kind").isin(*KINDS)), folder)
    held = spark.read.schema("value string, n long, kind string").parquet(folder)
    raw = held.withColumn("f", F.split("value", TAB))
    head = held.filter("kind = 'H'").agg(F.min_by("value", "n").alias("h")).first().h
    two = "VN:Z:2" in head if head is not None else not held.filter(F.col("kind").isin("E", "G", "O")).isEmpty()
    lines = lambda kind: raw.filter(F.col("kind") == kind).drop("kind")
    name = lambda c: F.regexp_replace(c, r"[+-]$", "")
    sign = lambda c: F.when(c.rlike("-$"), "-").otherwise("+")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    seq_at, tag_at = (3, 4) if two else (2, 3)
    s = lines("S").withColumn("tags", tags_of(_rest(tag_at)))
    length = _tag(F.col("tags"), "LN").try_cast("long")
    segments = s.select(
        _col(1).alias("header"), F.coalesce(_tag(F.col("tags"), "CM"), F.lit("")).alias("comment"), F.col("n").alias("seq_pos"), F.when(_col(seq_at) != "*", _col(seq_at)).alias("sequence"),
        _tag(F.col("tags"), "QL").alias("quality"), (F.coalesce(length, _col(2).try_cast("long")) if two else length).alias("ln_length"), "tags",
    )
    if two:
        pair = lambda df: df.select("n", F.when(_col(1) != "*", _col(1)).alias("header"), name(_col(2)).alias("s1"), sign(_col(2)).alias("s1_or"), name(_col(3)).alias("s2"), sign(_col(3)).alias("s2_or"), "f")
        gaps = _named(pair(lines("G")), "gap").select("header", "s1", "s1_or", "s2", "s2_or", number(_col(4)).alias("dist"), tags_of(_rest(5)).alias("tags"), "n")
        edges = _named(pair(lines("E")), "edge").select("header", "s1", "s1_or", "s2", "s2_or", _col(8).alias("cigar"), tags_of(_rest(9)).alias("tags"), "n")
        p = lines("O")
    else:
        pair = lambda df: df.select("n", F.lit(None).cast("string").alias("header"), _col(1).alias("s1"), _col(2).alias("s1_or"), _col(3).alias("s2"), _col(4).alias("s2_or"), "f")
        gaps = _named(pair(lines("J")), "gap").select("header", "s1", "s1_or", "s2", "s2_or", number(_col(5)).alias("dist"), tags_of(_rest(6)).alias("tags"), "n")
        edges = _named(pair(lines("L")), "edge").select("header", "s1", "s1_or", "s2", "s2_or", _col(5).alias("cigar"), tags_of(_rest(6)).alias("tags"), "n")
        p = lines("P")
    comment = F.try_element_at(F.transform(F.filter("f", lambda x: x.rlike("^(C|CM):Z:")), lambda x: F.regexp_replace(x, "^(C|CM):Z:", "")), F.lit(1))
    paths = p.select(_col(1).alias("header"), F.coalesce(comment, F.lit("")).alias("comment"), F.col("n").alias("seq_pos"))
    comps = _gfa2_components(p, gaps, edges) if two else _gfa1_components(p, gaps, edges)
    return Assembly(segments, gaps.drop("n"), edges.drop("n"), paths, comps)


_PLAIN = r"^[0-9A-Za-z_.:|#]+[+-]?\z"
_TOKEN = r"^(.*?)([+-])?(?:\((\d+):(\d+)\))?([+-])?$"


def _token(t: Column) -> tuple[Column, Column, Column, Column]:
    """Of the column ``t``: name, sign ('' if none), start and end; the slice may stand before or after the sign."""
    part = lambda i: F.regexp_extract(t, _TOKEN, i)
    n = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
    # most tokens are a name and at most one sign: these need no search
    last = F.right(t, F.lit(1))
    signed = last.isin("+", "-")
    plain = t.rlike(_PLAIN)
    zero = F.lit(0).cast("long")
    return (
        F.when(~plain, part(1)).when(signed, F.expr("substring(t, 1, length(t) - 1)")).otherwise(t), F.when(~plain, F.concat(part(2), part(5))).when(signed, last).otherwise(""),
        F.when(plain, zero).otherwise(n(3)), F.when(plain, zero).otherwise(n(4)),
    )


def _gfa2_components(p: DataFrame, gaps: DataFrame, edges: DataFrame) -> DataFrame:
    rows = p.select(_col(1).alias("path"), F.posexplode(F.split(_col(2), " ")).alias("i", "t")).filter("t <> ''")
    name, sign, start, end = _token(F.col("t"))
    rows = rows.select("path", (F.col("i") + 1).cast("long").alias("ord"), name.alias("comp"), sign.alias("o"), start.alias("start"), end.alias("end"))
    named = edges.select(F.col("header").alias("e")).distinct()
    rows = rows.join(named, (F.col("comp") == F.col("e")) & (F.col("o") == ""), "left")
    ctype = F.when(F.col("o") != "", SEGMENT).when(F.col("e").isNotNull(), EDGE).otherwise(GAP)
    return rows.select("path", "ord", ctype.alias("ctype"), "comp", F.when(F.col("o") == "", "0").otherwise(F.col("o")).alias("orientation"), "start", "end")


def _gfa1_components(p: DataFrame, gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps between tokens are found by the unordered pair of their ends, the first in the file; an edge step
    that the file lacks is skipped."""
    tokens = F.regexp_extract_all(_col(2), F.lit(r"([^,;]*[,;]?)"), F.lit(1))
    rows = p.select(_col(1).alias("path"), F.posexplode(tokens).alias("i", "raw")).filter("raw <> ''")
    rows = rows.withColumn("step", F.regexp_extract("raw", "([,;])$", 1)).withColumn("t", F.regexp_replace("raw", "[,;]$", ""))
    name, sign, start, end = _token(F.col("t"))
    rows = rows.withColumn("comp", name).withColumn("o", F.when(sign == "", "+").otherwise(sign)).withColumn("start", start).withColumn("end", end)
    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("next", F.lead("comp").over(w)).withColumn("prev", F.lag("comp").over(w))
    a = F.when(F.col("comp") == "", F.col("next")).otherwise(F.col("comp"))
    b = F.when(F.coalesce("next", F.lit("")) == "", F.col("comp")).otherwise(F.col("next"))
    steps = rows.filter("step <> ''").select("path", "i", "step", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    key = lambda df, kind: df.groupBy(F.least("s1", "s2").alias("x"), F.greatest("s1", "s2").alias("y")).agg(F.min_by("header", "n").alias("comp")).withColumn("step", F.lit(kind))
    found = steps.join(key(gaps, ";").unionByName(key(edges, ",")), ["x", "y", "step"])
    zero = F.lit(0).cast("long")
    inner = found.select("path", (F.col("i") * 2 + 1).alias("ord"), F.when(F.col("step") == ";", GAP).otherwise(EDGE).alias("ctype"), "comp", F.lit("0").alias("orientation"), zero.alias("start"), zero.alias("end"))
    own = rows.filter("comp <> ''").select("path", (F.col("i") * 2).alias("ord"), F.lit(SEGMENT).alias("ctype"), "comp", F.col("o").alias("orientation"), "start", "end")
    return renumber(own.unionByName(inner)).select("path", "ord", "ctype", "comp", "orientation", "start", "end")


def split_assembly(records: DataFrame, hc_cutoff: int = 0) -> Assembly:
    """FASTA or FASTQ records cut at their gaps, each a path; before that, runs of more than ``hc_cutoff`` equal bases as one (0: not)."""
    spark = records.sparkSession
    records = ingest.homopolymer_compressed(records, hc_cutoff)
    feats = ingest.features(records)
    segs = ingest.segments_of(feats)
    none = F.expr("cast(array() as array<struct<label:string,type:string,content:string>>)")
    segments = segs.select(F.col("name").alias("header"), F.lit("").alias("comment"), F.col("i").alias("seq_pos"), F.col("text").alias("sequence"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("long").alias("ln_length"), none.alias("tags"))
    gaps = ingest.gaps_of(feats).select(F.col("name").alias("header"), "s1", "s1_or", "s2", "s2_or", "dist", none.alias("tags"))
    edges = spark.createDataFrame([], "header string, s1 string, s1_or string, s2 string, s2_or string, cigar string, tags array<struct<label:string,type:string,content:string>>")
    return Assembly(segments, gaps, edges, records.select("header", "comment", "seq_pos"), ingest.components_of(feats))


def read_assembly(spark: SparkSession, path: str, hc_cutoff: int = 0, include: DataFrame | None = None, exclude: DataFrame | None = None) -> Assembly:
    """By the first character; the lists (BED) apply to records, or to the segments of a graph."""
    if sniff(spark, path) == "gfa":
        return filters.filter_assembly(read_gfa(spark, path), include, exclude)
    records = read_sequences(spark, path)
    both = ("sequence", "quality")
    if include is not None and exclude is not None:
        records = filters.neither(records, include, exclude)
    elif include is not None:
        records = filters.include(records, include, both)
    elif exclude is not None:
        records = filters.exclude(records, exclude, both)
    return split_assembly(records, hc_cutoff)


# -- intervals and AGP ------------------------------------------------------------------------------


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one, two or three columns; without coordinates the whole record (0, 0)."""
    f = spark.read.text(path).filter("value <> '' AND NOT value LIKE '#%'").withColumn("ord", F.monotonically_increasing_id()).withColumn("f", F.split("value", TAB))
    n = lambda i: F.coalesce(_col(i).try_cast("long"), F.lit(0).cast("long"))
    out = f.select(_col(0).alias("chrom"), n(1).alias("start"), n(2).alias("end"), "ord")
    assert [c.split()[0] for c in BED.split(", ")] == out.columns
    return out


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).filter("value <> '' AND NOT value LIKE '#%'").withColumn("line_no", F.monotonically_increasing_id()).withColumn("f", F.split("value", TAB))
    n = lambda i, c: _col(i).try_cast("long").alias(c)
    out = f.select(_col(0).alias("object"), n(1, "obj_start"), n(2, "obj_end"), n(3, "part"), _col(4).alias("ctype"), *(_col(i).alias(f"c{i + 1}") for i in range(5, 9)), "line_no")
    assert [c.split()[0] for c in AGP.split(", ")] == out.columns
    return out


def apply_agp(components: DataFrame, agp: DataFrame, discovered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scaffolds rebuilt by an AGP table from paths: (components with len, rows that named no path).

    ``components`` needs len. A W row takes bases beg to end of the path it names, reversed for -; N and U rows
    are gaps, and such at either end of an object are left out. Objects replace the paths. ``discovered``: a W row names a
    segment, whose path is ``<segment>_path`` (those that ``discover_paths`` makes).
    """
    rows = agp.select("object", "line_no", F.col("ctype").alias("row"), F.col("c6").alias("name"), F.col("c7").try_cast("long").alias("lo"), F.col("c8").try_cast("long").alias("hi"), F.when(F.col("c9") == "-", "-").otherwise("+").alias("sign"))
    w_rows = rows.filter("row = 'W'")
    if discovered:
        w_rows = w_rows.withColumn("name", F.concat("name", F.lit("_path")))
    missing = w_rows.join(components.select(F.col("path").alias("name")).distinct(), "name", "left_anti")
    used = w_rows.join(components, F.col("name") == F.col("path")).withColumn("path", F.concat_ws("\x1f", "object", "line_no", "name"))
    segs = revcom(trim(used, F.col("lo"), F.col("hi")), F.col("sign") == "-")
    zero = F.lit(0).cast("long")
    gaps = rows.filter("row IN ('N', 'U')").select("object", "line_no", zero.alias("ord"), F.lit(GAP).alias("ctype"), F.concat_ws("_", F.lit("gap"), "object", "line_no").alias("comp"), F.lit("0").alias("orientation"), zero.alias("start"), zero.alias("end"), F.col("name").try_cast("long").alias("len"))
    both = segs.select("object", "line_no", "ord", "ctype", "comp", "orientation", "start", "end", "len").unionByName(gaps)
    w = Window.partitionBy("object").orderBy("line_no", "ord")
    inside = both.withColumn("before", F.max(F.when(F.col("ctype") == SEGMENT, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.max(F.when(F.col("ctype") == SEGMENT, 1)).over(w.rowsBetween(0, Window.unboundedFollowing)))
    kept = inside.filter("before = 1 AND after = 1").withColumn("path", F.col("object"))
    return renumber(kept, "line_no", "ord").select(*[c.split()[0] for c in COMPONENTS.split(", ")], "len"), missing.select("object", "name")
