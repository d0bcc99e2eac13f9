"""Writers: each builds the lines of a format as a DataFrame; ``write_lines`` stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.functions import seq as S
from contigua.model import EDGE, GAP, SEGMENT, Assembly
from contigua.operators.stats import offsets, placed
from contigua.operators.variants import on_paths

TAB = "\t"


def write_lines(lines: DataFrame, path: str, column: str = "line", order: tuple[str, ...] = (), gzip: bool = False) -> None:
    """Text files in the folder ``path``; with ``order``, the files and their lines follow it."""
    rows = lines.orderBy(*order) if order else lines
    rows.select(column).write.mode("overwrite").text(path, compression="gzip" if gzip else "none")


def _line(*parts: Column | str) -> Column:
    return F.concat_ws(TAB, *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def tag_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["label"], t["type"], t["content"])), TAB)


def _with_tags(line: Column, df: DataFrame) -> Column:
    return F.concat_ws(TAB, line, F.when(F.size("tags") > 0, tag_text(F.col("tags")))) if "tags" in df.columns else line


# -- sequences --------------------------------------------------------------------------------------


def path_sequences(components: DataFrame) -> DataFrame:
    """(path, seq, quality): components in order; gaps as N, reverse strands complemented, and after an edge the
    overlap dropped from the segment that follows it, and from that one only.

    Needs path, ord, ctype, orientation, len and text (the slice); may have quality and, on edges, overlap.
    A path is put together in one row, as its FASTA record is.
    """
    has = components.columns
    before = Window.partitionBy("path").orderBy("ord")
    quality = F.coalesce(F.col("quality") if "quality" in has else F.lit(None).cast("string"), F.expr("repeat('!', cast(len as int))"))
    minus = F.col("orientation") == "-"
    rows = components.withColumn("__q", F.when(minus, F.reverse(quality)).otherwise(quality)).withColumn("__s", F.when(minus, S.revcomp(F.col("text"))).otherwise(F.col("text")))
    drop = F.coalesce(F.when(F.lag("ctype").over(before) == EDGE, F.lag("overlap").over(before)), F.lit(0)) if "overlap" in has else F.lit(0)
    rows = rows.withColumn("__drop", drop.cast("int"))
    piece = lambda c: F.when(F.col("ctype") == EDGE, "").otherwise(F.expr(f"substring({c}, __drop + 1, length({c}))"))
    gap = F.col("ctype") == GAP
    rows = rows.select("path", "ord", F.when(gap, F.expr("repeat('N', cast(len as int))")).otherwise(piece("__s")).alias("s"), F.when(gap, F.expr("repeat('!', cast(len as int))")).otherwise(piece("__q")).alias("q"))
    listed = lambda c: F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("t"))))
    held = rows.groupBy("path").agg(listed("s").alias("s"), listed("q").alias("q"))  # apart, so that one that is not asked for is not collected
    joined = lambda c: F.array_join(F.transform(c, lambda e: e["t"]), "")
    return held.select("path", joined("s").alias("seq"), joined("q").alias("quality"))


def fasta_lines(records: DataFrame, width: int = 0) -> DataFrame:
    """(line) of (header, comment, sequence); one record a line group."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "header", F.when(F.col("comment") != "", F.col("comment"))))
    body = S.text_wrap(F.col("sequence"), width) if width else F.col("sequence")
    return records.select(*[c for c in ("seq_pos",) if c in records.columns], F.concat_ws("\n", head, body).alias("line"))


def fastq_lines(records: DataFrame) -> DataFrame:
    quality = F.coalesce("quality", F.expr("repeat('!', length(sequence))"))
    head = F.concat(F.lit("@"), F.concat_ws(" ", "header", F.when(F.col("comment") != "", F.col("comment"))))
    return records.select(*[c for c in ("seq_pos",) if c in records.columns], F.concat_ws("\n", head, F.col("sequence"), F.lit("+"), quality).alias("line"))


# -- graphs -----------------------------------------------------------------------------------------


def gfa1_segments(segments: DataFrame, no_sequence: bool = False) -> DataFrame:
    """Without a sequence: * and its length as LN; quality as QL."""
    has = segments.columns
    missing = F.col("sequence").isNull() | F.lit(no_sequence)
    length = F.coalesce(F.length("sequence").cast("long"), F.col("ln_length") if "ln_length" in has else F.lit(None).cast("long"))
    extra = [F.when(missing & length.isNotNull(), F.concat(F.lit("LN:i:"), length.cast("string")))]
    if "quality" in has:
        extra.append(F.when(~missing, F.concat(F.lit("QL:Z:"), "quality")))
    line = F.concat_ws(TAB, F.lit("S"), "header", F.when(missing, "*").otherwise(F.col("sequence")), *extra)
    if "tags" in has:
        kept = F.filter("tags", lambda t: ~t["label"].isin("LN", "QL"))
        line = F.concat_ws(TAB, line, F.when(F.size(kept) > 0, tag_text(kept)))
    return segments.select(line.alias("line"))


def gfa1_edges(edges: DataFrame) -> DataFrame:
    return edges.select(_with_tags(_line("L", F.col("s1"), F.col("s1_or"), F.col("s2"), F.col("s2_or"), F.col("cigar")), edges).alias("line"))


def gfa1_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.select(_with_tags(_line("J", F.col("s1"), F.col("s1_or"), F.col("s2"), F.col("s2_or"), F.col("dist")), gaps).alias("line"))


def _tokens(components: DataFrame, name: Column) -> DataFrame:
    """(path, ord, token, prev, next) of the components."""
    w = Window.partitionBy("path").orderBy("ord")
    return components.withColumn("token", name).withColumn("prev", F.lag("ctype").over(w)).withColumn("next", F.lead("ctype").over(w))


def _slice() -> Column:
    whole = (F.col("start") == 0) & (F.col("end") == 0)
    return F.when(whole, "").otherwise(F.concat(F.lit("("), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit(")")))


def gfa1_paths(components: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``name(start:end)sign`` tokens; ; stands where a gap follows (also before the first segment), , elsewhere."""
    rows = _tokens(components, F.concat(F.col("comp"), _slice(), F.col("orientation")))
    after = F.when(F.col("next") == GAP, ";").when(F.col("next").isNotNull(), ",").otherwise("")
    text = F.when(F.col("ctype") == SEGMENT, F.concat("token", after)).when((F.col("ctype") == GAP) & F.col("prev").isNull(), ";").otherwise("")
    held = rows.select("path", "ord", text.alias("t")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x"))
    tokens = held.select("path", F.array_join(F.transform("x", lambda e: e["t"]), "").alias("t"))
    if paths is None:
        return tokens.select(_line("P", F.col("path"), F.col("t"), "*").alias("line"))
    named = paths.join(tokens, F.col("header") == F.col("path"))
    comment = F.when(F.col("comment") != "", F.concat(F.lit("C:Z:"), "comment"))
    return named.select(F.concat_ws(TAB, F.lit("P"), "path", "t", F.lit("*"), comment).alias("line"))


def gfa1_lines(a: Assembly, no_sequence: bool = False) -> DataFrame:
    """(kind, line): header, S, L, J and P, in that order by kind."""
    spark = a.segments.sparkSession
    parts = [spark.createDataFrame([("H\tVN:Z:1.2",)], "line string"), gfa1_segments(a.segments, no_sequence), gfa1_edges(a.edges), gfa1_gaps(a.gaps), gfa1_paths(a.components, a.paths)]
    out = None
    for kind, lines in enumerate(parts):
        rows = lines.select(F.lit(kind).alias("kind"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def gfa2_lines(a: Assembly, no_sequence: bool = False) -> DataFrame:
    """(kind, line): H, S, E, G and O, in the standard's column order."""
    spark = a.segments.sparkSession
    ref = lambda name, sign: F.concat(F.col(name), F.col(sign))
    length = F.coalesce(F.length("sequence").cast("long"), F.col("ln_length"))
    seq = F.when(F.col("sequence").isNull() | F.lit(no_sequence), "*").otherwise(F.col("sequence"))
    edges = a.edges.select(_line("E", F.col("header"), ref("s1", "s1_or"), ref("s2", "s2_or"), "0", "0", "0", "0", F.col("cigar")).alias("line"))
    gaps = a.gaps.select(_line("G", F.col("header"), ref("s1", "s1_or"), ref("s2", "s2_or"), F.col("dist"), "*").alias("line"))
    token = F.concat(F.col("comp"), F.when(F.col("orientation") == "0", "").otherwise(F.col("orientation")), _slice())
    held = a.components.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", token.alias("t")))).alias("x")).select("path", F.array_join(F.transform("x", lambda e: e["t"]), " ").alias("t"))
    comment = F.when(F.col("comment") != "", F.concat(F.lit("C:Z:"), "comment"))
    paths = a.paths.join(held, F.col("header") == F.col("path")).select(F.concat_ws(TAB, F.lit("O"), "path", "t", comment).alias("line"))
    parts = [spark.createDataFrame([("H\tVN:Z:2.0",)], "line string"), a.segments.select(_line("S", F.col("header"), length, seq).alias("line")), edges, gaps, paths]
    out = None
    for kind, lines in enumerate(parts):
        rows = lines.select(F.lit(kind).alias("kind"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out


# -- coordinates ------------------------------------------------------------------------------------


def agp_lines(offsets: DataFrame) -> DataFrame:
    """(path, ord, line) from components with begin, stop, part and len."""
    at = [F.col("path"), F.col("begin") + 1, F.col("stop"), F.col("part")]
    whole = (F.col("start") == 0) & (F.col("end") == 0)
    segment = _line(*at, "W", F.col("comp"), F.when(whole, 1).otherwise(F.col("start")), F.when(whole, F.col("len")).otherwise(F.col("end")), F.col("orientation"))
    gap = _line(*at, "N", F.col("len"), F.col("comp"), "yes")
    return offsets.filter(F.col("ctype") != EDGE).select("path", "ord", F.when(F.col("ctype") == GAP, gap).otherwise(segment).alias("line"))


def bed_lines(offsets: DataFrame, ctype: str) -> DataFrame:
    return offsets.filter(F.col("ctype") == ctype).select("path", "ord", _line(F.col("path"), F.col("begin"), F.col("stop")).alias("line"))


def report_lines(metrics: DataFrame, tabular: bool = False) -> DataFrame:
    return metrics.select(F.concat("metric", F.lit(TAB if tabular else ": "), F.format_string("%.2f", "value")).alias("line"))


# -- variants ---------------------------------------------------------------------------------------

#: What a VCF begins with.
VCF_HEAD = (
    "##fileformat=VCFv4.2",
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE",
)


def vcf_lines(offsets: DataFrame, variants: DataFrame) -> DataFrame:
    """(path, pos, line): a line a variant group and place where its segment stands on a path, whole within the slice.

    ``variants``: segment, grp, alt, vtype (SNV, INS, DEL, COM), ref_len, pos (0-based on the segment), sequence,
    score. Alternatives of a group share a line; turned segments give theirs on the path's strand. See ``operators.variants``.
    """
    q = F.format_string("%.2f", "q")
    line = _line(F.col("path"), F.col("pos"), ".", F.col("ref"), F.array_join("alts", ","), q, "PASS", ".", "GT:GQ", F.concat(F.lit("1/1:"), q))
    return on_paths(offsets, variants).select("path", "pos", line.alias("line"))


# -- by format --------------------------------------------------------------------------------------

#: Words and suffixes that name a format.
FORMATS = {"fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "gfa": "gfa", "gfa2": "gfa2", "vcf": "vcf"}


def format_of(target: str) -> tuple[str, bool, str | None]:
    """(format, gzip, path) of a format's word, as ``gfa`` or ``fa.gz``, or of a path that ends in one; a word alone has no path."""
    name = target.rsplit("/", 1)[-1]
    plain = name.removesuffix(".gz")
    word = plain.rpartition(".")[2].lower()
    if word not in FORMATS:
        raise ValueError(f"no format is known by {target!r}")
    return FORMATS[word], plain != name, None if "/" not in target and plain.lower() in FORMATS else target


def assembly_lines(a: Assembly, form: str, variants: DataFrame | None = None, width: int = 0) -> DataFrame:
    """(kind, ord, line) of an assembly in a format, to be ordered by the first two."""
    spark = a.segments.sparkSession
    if form in ("gfa", "gfa2"):
        lines = gfa1_lines(a) if form == "gfa" else gfa2_lines(a)
        return lines.select("kind", F.lit("").alias("ord"), "line")
    components = placed(a.components, a.segments, a.gaps)
    if form == "vcf":
        head = spark.createDataFrame([(i, "", h) for i, h in enumerate(VCF_HEAD)], "kind int, ord string, line string")
        if variants is None:
            return head
        rows = vcf_lines(offsets(components), variants)
        return head.unionByName(rows.select(F.lit(len(VCF_HEAD)).alias("kind"), F.concat_ws(" ", "path", F.lpad(F.col("pos").cast("string"), 20, "0")).alias("ord"), "line"))
    if a.edges is not None:
        overlap = a.edges.select(F.col("header").alias("__e"), S.cigar_match(F.col("cigar")).alias("overlap"))
        components = components.join(overlap, (F.col("comp") == F.col("__e")) & (F.col("ctype") == EDGE), "left").drop("__e")
    records = path_sequences(components).join(a.paths.select(F.col("header").alias("path"), "comment"), "path").select(F.col("path").alias("header"), "comment", F.col("seq").alias("sequence"), "quality")
    lines = fasta_lines(records.withColumn("seq_pos", F.col("header")), width) if form == "fasta" else fastq_lines(records.withColumn("seq_pos", F.col("header")))
    return lines.select(F.lit(0).alias("kind"), F.col("seq_pos").alias("ord"), "line")


def write_assembly(a: Assembly, target: str, variants: DataFrame | None = None, width: int = 0) -> DataFrame:
    """Writes in the format that a path's suffix names, gzip by ``.gz``; a format's word alone writes nothing. Returns the lines."""
    form, gzip, path = format_of(target)
    lines = assembly_lines(a, form, variants, width)
    if path is not None:
        write_lines(lines, path, order=("kind", "ord"), gzip=gzip)
    return lines
