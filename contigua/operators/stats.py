"""Assembly statistics. N* and friends work on the distinct lengths, so the one global window sorts
as many rows as there are lengths, not sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.functions import seq as S
from contigua.model import GAP, SEGMENT
from contigua.operators.lineage import Rounds


def _times(times: str | None) -> Column:
    """How often a length is there: once a row, or as a column says."""
    return F.col(times) if times else F.lit(1)


def nstar(lengths: DataFrame, column: str = "len", genome_size: int | None = None, times: str | None = None) -> DataFrame:
    """(n, nx, lx) for n = 1 .. 10 (N10 .. N100): the length at which the sorted sum first reaches n tenths of
    the total, or of ``genome_size``, and how many sequences that takes; 0 where it is never reached."""
    by_len = lengths.groupBy(F.col(column).cast("long").alias("len")).agg(F.sum(_times(times)).alias("n_len"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("len"))
    whole = Window.partitionBy(F.lit(1))
    weight = F.col("len") * F.col("n_len")
    cum = by_len.select("len", "n_len", F.sum(weight).over(down).alias("cs"), F.sum("n_len").over(down).alias("cn"), F.sum(weight).over(whole).alias("tot"))
    base = F.lit(genome_size).cast("double") if genome_size else F.col("tot").cast("double")
    tenths = cum.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("need", base / 10 * F.col("n")).filter((F.col("cs") >= F.col("need")))
    first = tenths.groupBy("n").agg(F.max(F.struct("len", "n_len", "cs", "cn", "need")).alias("x"))
    taken = F.greatest(F.ceil((F.col("x.need") - (F.col("x.cs") - F.col("x.len") * F.col("x.n_len"))) / F.col("x.len")), F.lit(1))
    got = first.select("n", F.col("x.len").alias("nx"), F.when(F.col("x.len") > 0, F.col("x.cn") - F.col("x.n_len") + taken).otherwise(1).cast("long").alias("lx"))
    all_n = lengths.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("n"))
    return all_n.join(got, "n", "left").select("n", F.coalesce("nx", F.lit(0)).cast("long").alias("nx"), F.coalesce("lx", F.lit(0)).cast("long").alias("lx"))


def aun(lengths: DataFrame, column: str = "len", genome_size: int | None = None, times: str | None = None) -> DataFrame:
    """(aun): sum of squared lengths over the total, or over ``genome_size``."""
    n = F.col(column).cast("decimal(38,0)")
    base = F.lit(genome_size).cast("double") if genome_size else F.sum(n * _times(times)).cast("double")
    return lengths.agg(F.round(F.try_divide(F.sum(n * n * _times(times)).cast("double"), base), 2).alias("aun"))


def length_summary(lengths: DataFrame, column: str = "len", times: str | None = None) -> DataFrame:
    """(n, total, average, largest, smallest); zeros and a null average for an empty table."""
    n = F.col(column)
    return lengths.agg(
        F.coalesce(F.sum(F.when(n.isNotNull(), _times(times))), F.lit(0)).alias("n"), F.coalesce(F.sum(n * _times(times)), F.lit(0)).alias("total"),
        F.round(F.try_divide(F.sum(n * _times(times)), F.sum(F.when(n.isNotNull(), _times(times)))), 2).alias("average"),
        F.coalesce(F.max(n), F.lit(0)).alias("largest"), F.coalesce(F.min(n), F.lit(0)).alias("smallest"),
    )


def merged_gaps(components: DataFrame, lengths: str = "len") -> DataFrame:
    """(path, island, len): adjacent gaps of a path as one. Needs path, ord, ctype and the gap's length."""
    w = Window.partitionBy("path").orderBy("ord")
    rows = components.withColumn("island", F.sum(F.when(F.col("ctype") == SEGMENT, 1).otherwise(0)).over(w))
    return rows.filter(F.col("ctype") == GAP).groupBy("path", "island").agg(F.sum(lengths).alias("len"))


def path_report(components: DataFrame) -> DataFrame:
    """Per path: components with length, bases and soft-masked counts (``len, a, c, g, t, lower``)."""
    seg = F.col("ctype") == SEGMENT
    flip = F.col("orientation") == "-"
    take = lambda col: F.coalesce(F.sum(F.when(seg, col)), F.lit(0)).cast("long")
    both = lambda one, other: F.when(flip, F.col(other)).otherwise(F.col(one))
    return components.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("ctype").isin(SEGMENT, GAP), F.col("len"))), F.lit(0)).cast("long").alias("length"),
        take(F.col("len")).alias("segment_length"), F.count(F.when(seg, 1)).alias("contig_n"),
        take(both("a", "t")).alias("a"), take(both("c", "g")).alias("c"), take(both("g", "c")).alias("g"), take(both("t", "a")).alias("t"), take(F.col("lower")).alias("lower"),
    )


def placed(components: DataFrame, segments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Components with what they stand for: ``len, a, c, g, t, lower`` of the slice. ``segments`` needs
    name and sequence (or ln_length), ``gaps`` name and dist."""
    seg = segments.select(F.col("header").alias("s_name"), "sequence", "ln_length")
    gap = gaps.select(F.col("header").alias("g_name"), "dist")
    joined = components.join(seg, (F.col("comp") == F.col("s_name")) & (F.col("ctype") == SEGMENT), "left").join(gap, (F.col("comp") == F.col("g_name")) & (F.col("ctype") == GAP), "left")
    part = S.slice_1(F.col("sequence"), F.col("start"), F.col("end"))
    whole = F.when(F.col("ctype") == GAP, F.col("dist")).otherwise(F.coalesce(F.length("sequence").cast("long"), F.col("ln_length")))
    return joined.select(
        *components.columns, part.alias("text"),
        F.when(F.col("ctype") == "EDGE", 0).otherwise(F.coalesce(S.slice_length(whole, F.col("start"), F.col("end")), F.lit(0))).cast("long").alias("len"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(b) for b, c in S.base_counts(part).items()), F.coalesce(S.lower_count(part), F.lit(0)).cast("long").alias("lower"),
    )


def segment_table(segments: DataFrame, circular: DataFrame, with_sequence: bool = False) -> DataFrame:
    """Per segment: header, comment, len, a, c, g, t, gc, soft_masked, circular[, sequence, quality]. ``circular`` lists nodes (node)."""
    n = S.base_counts(F.col("sequence"))
    length = F.coalesce(F.length("sequence").cast("long"), F.col("ln_length"))
    joined = segments.join(circular.select(F.col("node").alias("__c")).distinct(), F.col("header") == F.col("__c"), "left")
    extra = ["sequence", "quality"] if with_sequence else []
    return joined.select(
        "header", "comment", length.alias("len"), *(F.coalesce(c, F.lit(0)).cast("long").alias(b) for b, c in n.items()), F.round(S.gc_content(n["a"], n["c"], n["g"], n["t"]), 2).alias("gc"),
        F.coalesce(S.lower_count(F.col("sequence")), F.lit(0)).cast("long").alias("soft_masked"), F.col("__c").isNotNull().alias("circular"), *extra,
    )


def path_table(paths: DataFrame, report: DataFrame, circular: DataFrame) -> DataFrame:
    """The path report with comment and circular. ``circular`` lists paths (path)."""
    figures = [c for c in report.columns if c != "path"]
    joined = paths.join(report.withColumnRenamed("path", "__p"), F.col("header") == F.col("__p"), "left").join(circular.select(F.col("path").alias("__c")).distinct(), F.col("header") == F.col("__c"), "left")
    return joined.select("header", "comment", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures), F.col("__c").isNotNull().alias("circular"))


def offsets(components: DataFrame) -> DataFrame:
    """With (begin, stop): each component's place on its path, 0-based half-open, and its part number."""
    w = Window.partitionBy("path").orderBy("ord")
    stop = F.sum("len").over(w)
    return components.withColumn("stop", stop).withColumn("begin", F.col("stop") - F.col("len")).withColumn("part", F.row_number().over(w))


def counted_once(components: DataFrame) -> DataFrame:
    """Components with len and counts but without their text, written to the shared folder: reports and lengths that are made of
    it read no sequence again."""
    return Rounds(components.sparkSession).write(components.drop("text"))


def metric_rows(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of figures as (metric, value) rows, labelled."""
    pairs = F.array(*(F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for c, label in names.items()))
    return row.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def assembly_summary(paths: DataFrame, contig_lengths: DataFrame, gap_lengths: DataFrame, genome_size: int | None = None) -> DataFrame:
    """(metric, value) of the whole assembly. ``paths`` is a path report.

    Each input is read once: the report, and the distinct lengths with their counts, are written to the shared folder, and all figures
    come from these.
    """
    out: DataFrame | None = None
    store = Rounds(paths.sparkSession, keep=1 << 30)
    paths = store.write(paths)
    counted = lambda df, kind: df.groupBy(F.col("len").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n_len")).select(F.lit(kind).alias("kind"), "len", "n_len")
    held = store.write(counted(paths.select(F.col("length").alias("len")), "scaffold").unionByName(counted(contig_lengths, "contig")).unionByName(counted(gap_lengths, "gap")))

    def add(rows: DataFrame) -> None:
        nonlocal out
        out = rows if out is None else out.unionByName(rows)

    for kind, where in (("scaffold", ""), ("contig", ""), ("gap", " in scaffolds")):
        lengths, name = held.filter(F.col("kind") == kind), kind.capitalize()
        add(metric_rows(length_summary(lengths, times="n_len"), {"n": f"# {kind}s{where}", "total": f"Total {kind} length{where}", "average": f"Average {kind} length{where}", "largest": f"Largest {kind}{where}", "smallest": f"Smallest {kind}{where}"}))
        add(metric_rows(nstar(lengths, times="n_len").filter("n = 5"), {"nx": f"{name} N50{where}", "lx": f"{name} L50{where}"}))
        add(metric_rows(aun(lengths, times="n_len"), {"aun": f"{name} auN{where}"}))
        if genome_size and kind != "gap":
            add(metric_rows(nstar(lengths, genome_size=genome_size, times="n_len").filter("n = 5"), {"nx": f"{name} NG50", "lx": f"{name} LG50"}))
            add(metric_rows(aun(lengths, genome_size=genome_size, times="n_len"), {"aun": f"{name} auNG"}))
    total = paths.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("a", "c", "g", "t", "lower")))
    total = total.withColumn("gc", F.round(S.gc_content(*(F.col(x) for x in "acgt")), 2))
    add(metric_rows(total, {"a": "Base composition A", "c": "Base composition C", "g": "Base composition G", "t": "Base composition T", "gc": "GC content %", "lower": "# soft-masked bases"}))
    return out

