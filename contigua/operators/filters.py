"""Include and exclude lists of BED intervals, for records and assemblies; tags; soft deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from contigua.model import SEGMENT, Assembly


def merged(bed: DataFrame) -> DataFrame:
    """Intervals sorted and united per record; (0, 0) stands for the whole record."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    rows = bed.select("chrom", "start", F.when((F.col("start") == 0) & (F.col("end") == 0), F.lit((1 << 31) - 2)).otherwise(F.col("end")).cast("long").alias("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def intervals(bed: DataFrame) -> DataFrame:
    """(chrom, spans): one row a record."""
    return merged(bed).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


_IN = "array_join(transform(spans, x -> substring({c}, cast(x.start + 1 as int), cast(x.end - x.start as int))), '')"
_OUT = (
    "concat(array_join(transform(spans, (x, i) -> substring({c}, cast(if(i = 0, 0, spans[i - 1].end) + 1 as int),"
    " cast(x.start - if(i = 0, 0, spans[i - 1].end) as int))), ''), substring({c}, cast(spans[size(spans) - 1].end + 1 as int), length({c})))"
)


def include(records: DataFrame, bed: DataFrame, columns: tuple[str, ...] = ("sequence",), key: str = "header") -> DataFrame:
    """Listed records, cut to the listed intervals, joined in order."""
    joined = records.join(intervals(bed), F.col(key) == F.col("chrom"))
    for c in columns:
        joined = joined.withColumn(c, F.expr(_IN.format(c=c)))
    return joined.select(*records.columns)


def exclude(records: DataFrame, bed: DataFrame, columns: tuple[str, ...] = ("sequence",), key: str = "header") -> DataFrame:
    """All records without the listed intervals; those listed as a whole, or with nothing left, go."""
    joined = records.join(intervals(bed), F.col(key) == F.col("chrom"), "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("spans").isNull(), F.col(c)).otherwise(F.expr(_OUT.format(c=c))))
    return joined.filter(F.col("spans").isNull() | (F.length(columns[0]) > 0)).select(*records.columns)


def neither(records: DataFrame, included: DataFrame, excluded: DataFrame, key: str = "header") -> DataFrame:
    """Both lists given: only records in neither stay."""
    listed = included.select("chrom").union(excluded.select("chrom"))
    return records.join(listed, F.col(key) == F.col("chrom"), "left_anti")


def filter_assembly(a: Assembly, included: DataFrame | None = None, excluded: DataFrame | None = None) -> Assembly:
    """The lists applied to segments (as to records: an exclude list leaves unlisted segments alone, both lists leave those in neither).
    Edges, gaps and paths that use a segment which goes, go too."""
    columns = tuple(c for c in ("sequence", "quality") if c in a.segments.columns)
    if included is not None and excluded is not None:
        segments = neither(a.segments, included, excluded)
    elif included is not None:
        segments = include(a.segments, included, columns)
    elif excluded is not None:
        segments = exclude(a.segments, excluded, columns)
    else:
        return a
    gone = a.segments.select(F.col("header").alias("__gone")).join(segments.select(F.col("header").alias("__gone")), "__gone", "left_anti")
    without = lambda df, *cols: _left_out(df, gone, cols)
    used = a.components.filter(F.col("ctype") == SEGMENT).join(gone, F.col("comp") == F.col("__gone"), "left_semi").select(F.col("path").alias("__gone")).distinct()
    return a.with_(segments=segments, gaps=without(a.gaps, "s1", "s2"), edges=without(a.edges, "s1", "s2"), paths=_left_out(a.paths, used, ("header",)), components=_left_out(a.components, used, ("path",)))


def _left_out(df: DataFrame, gone: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        df = df.join(gone, F.col(c) == F.col("__gone"), "left_anti")
    return df


def flag_deleted(segments: DataFrame, *names: str) -> DataFrame:
    """Soft deletion: a column ``deleted``, true for the named and for those flagged before."""
    before = F.coalesce("deleted", F.lit(False)) if "deleted" in segments.columns else F.lit(False)
    return segments.withColumn("deleted", before | F.col("header").isin(*names))


def live(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in segments.columns else segments


def with_tag(records: DataFrame, label: str, content: str | None = None) -> DataFrame:
    hit = F.exists("tags", lambda t: (t["label"] == label) & (F.lit(True) if content is None else t["content"] == content))
    return records.filter(hit)


def tag(label: str):
    return F.try_element_at(F.transform(F.filter("tags", lambda t: t["label"] == label), lambda t: t["content"]), F.lit(1))
