"""Edits of path components, as functions from DataFrame to DataFrame.

Components are rows (path, ord, ctype, comp, orientation, start, end); where lengths matter they come with ``len``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.operators.lineage import Rounds
from contigua.model import GAP, SEGMENT

KEYS = ["path", "ord", "ctype", "comp", "orientation", "start", "end"]


def renumber(components: DataFrame, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("path").orderBy(*(order or ("ord",)))
    return components.withColumn("ord", F.row_number().over(w).cast("long"))


def revcom(components: DataFrame, only: Column | None = None, last: Column | None = None) -> DataFrame:
    """Reverses the order and flips + and -; 0 stays. ``only`` picks the rows of the paths to turn; ``last`` is a path's greatest ord, where its rows
    know it, and spares a shuffle."""
    turned = F.lit(True) if only is None else only
    rows = components.withColumn("__last", F.max("ord").over(Window.partitionBy("path")) if last is None else last)
    return rows.withColumn("ord", F.when(turned, F.col("__last") - F.col("ord") + 1).otherwise(F.col("ord"))).withColumn("orientation", F.when(turned, F.translate("orientation", "+-", "-+")).otherwise(F.col("orientation"))).drop("__last")


def trim(placed: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Path bases lo to hi, 1-based inclusive; ``placed`` has len. Components outside go, those at the
    ends get a start and end of their own, mirrored where they stand reversed."""
    w = Window.partitionBy("path").orderBy("ord")
    rows = placed.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__stop", F.sum("len").over(w))
    rows = rows.withColumn("__begin", F.col("__stop") - F.col("len"))
    rows = rows.filter((F.col("__stop") >= F.col("__lo")) & (F.col("__begin") < F.col("__hi")) & (F.col("len") > 0))
    head = F.greatest(F.col("__lo") - F.col("__begin") - 1, F.lit(0))
    tail = F.greatest(F.col("__stop") - F.col("__hi"), F.lit(0))
    first = F.when((F.col("start") == 0) & (F.col("end") == 0), 1).otherwise(F.col("start"))
    last = first + F.col("len") - 1
    minus = F.col("orientation") == "-"
    cut = (head + tail) > 0
    rows = rows.withColumn("__first", first + F.when(minus, tail).otherwise(head)).withColumn("__last", last - F.when(minus, head).otherwise(tail))
    rows = rows.withColumn("start", F.when(cut, F.col("__first")).otherwise(F.col("start"))).withColumn("end", F.when(cut, F.col("__last")).otherwise(F.col("end"))).withColumn("len", F.col("len") - head - tail)
    return renumber(rows.drop("__lo", "__hi", "__stop", "__begin", "__first", "__last"))


def join_paths(components: DataFrame, first: DataFrame, second: DataFrame, gap: str, new: str) -> DataFrame:
    """``first`` + gap + ``second`` as the path ``new``, added to ``components``."""
    a = first.select(F.lit(0).alias("__side"), *KEYS)
    spark = components.sparkSession
    between = spark.createDataFrame([(1, new, 0, GAP, gap, "0", 0, 0)], "__side int, " + "path string, ord long, ctype string, comp string, orientation string, start long, end long")
    c = second.select(F.lit(2).alias("__side"), *KEYS)
    joined = a.unionByName(between).unionByName(c).withColumn("path", F.lit(new))
    return components.select(*KEYS).unionByName(renumber(joined, "__side", "ord").select(*KEYS))


def split_at(components: DataFrame, path: Column, at: Column, new1: str, new2: str) -> DataFrame:
    """The path's components before place ``at`` become ``new1``, those after it ``new2``; the one there goes."""
    mine = path
    rows = components.filter(~mine | (F.col("ord") != at))
    named = F.when(mine & (F.col("ord") < at), F.lit(new1)).when(mine, F.lit(new2)).otherwise(F.col("path"))
    return renumber(rows.withColumn("path", named))


def excise(components: DataFrame, contig: Column, gap_name: Column) -> DataFrame:
    """Segments for which ``contig`` holds go with the gaps on either side; where something stands on both sides
    one new gap ``gap_name`` takes their place. Adjacent excised triples become one gap."""
    w = Window.partitionBy("path").orderBy("ord")
    hit = contig & (F.col("ctype") == SEGMENT)
    rows = components.withColumn("__hit", hit)
    near = F.coalesce(F.lag("__hit").over(w), F.lit(False)) | F.coalesce(F.lead("__hit").over(w), F.lit(False))
    rows = rows.withColumn("__gone", F.col("__hit") | ((F.col("ctype") == GAP) & near))
    rows = rows.withColumn("__head", F.col("__gone") & ~F.coalesce(F.lag("__gone").over(w), F.lit(False)))
    left = F.max(F.when(~F.col("__gone"), F.col("ord"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(~F.col("__gone"), F.col("ord"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__inner", left.isNotNull() & right.isNotNull())
    rows = rows.filter(~F.col("__gone") | (F.col("__head") & F.col("__inner")))
    new = F.col("__gone")
    rows = rows.withColumn("comp", F.when(new, gap_name).otherwise(F.col("comp"))).withColumn("ctype", F.when(new, GAP).otherwise(F.col("ctype"))).withColumn("orientation", F.when(new, "0").otherwise(F.col("orientation")))
    rows = rows.withColumn("start", F.when(new, 0).otherwise(F.col("start"))).withColumn("end", F.when(new, 0).otherwise(F.col("end")))
    return renumber(rows.drop("__hit", "__gone", "__head", "__inner"))


def mask(placed: DataFrame, lo: Column, hi: Column, gap_name: Column, size: Column) -> DataFrame:
    """Path bases [lo, hi), 0-based, become a gap of ``size``; ``placed`` has len. lo must be below hi."""
    inside = placed.groupBy("path").agg(F.sum("len").alias("__total"))
    rows = placed.join(inside, "path").withColumn("__a", lo).withColumn("__b", F.least(hi, F.col("__total"))).withColumn("__size", size).withColumn("__gap", gap_name)
    left = trim(rows.filter("__a > 0"), F.lit(1), F.col("__a")).withColumn("__side", F.lit(0))
    right = trim(rows.filter("__b < __total"), F.col("__b") + 1, F.col("__total")).withColumn("__side", F.lit(2))
    gap = rows.groupBy("path").agg(F.first("__gap").alias("comp"), F.first("__size").alias("len"))
    gap = gap.select("path", F.lit(0).cast("long").alias("ord"), F.lit(GAP).alias("ctype"), "comp", F.lit("0").alias("orientation"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "len", F.lit(1).alias("__side"))
    cols = [*KEYS, "len", "__side"]
    return renumber(left.select(*cols).unionByName(gap.select(*cols)).unionByName(right.select(*cols)), "__side", "ord").drop("__side")


def cleave_components(components: DataFrame, contig: Column, left: Column, right: Column) -> DataFrame:
    """Whole components of a cleaved segment become its two parts, in order of their strand."""
    minus = F.col("orientation") == "-"
    parts = F.when(contig & minus, F.array(right, left)).when(contig, F.array(left, right)).otherwise(F.array("comp"))
    rows = components.select(*[c for c in components.columns if c != "comp"], F.posexplode(parts).alias("__p", "comp"))
    return renumber(rows, "ord", "__p").drop("__p").select(*components.columns)


def cleave_edges(edges: DataFrame, contig: str, left: str, right: str, edge: str | None = None) -> DataFrame:
    """Edges at the segment's right end go to ``right``, others to ``left``; ``edge`` names a 0M link of the two."""
    s1 = F.when(F.col("s1") != contig, F.col("s1")).when(F.col("s1_or") == "+", right).otherwise(left)
    s2 = F.when(F.col("s2") != contig, F.col("s2")).when(F.col("s2_or") == "+", left).otherwise(right)
    moved = edges.withColumn("s1", s1).withColumn("s2", s2)
    if not edge:
        return moved
    row = edges.sparkSession.createDataFrame([(edge, left, "+", right, "+", "0M")], "header string, s1 string, s1_or string, s2 string, s2_or string, cigar string")
    return moved.unionByName(row, allowMissingColumns=True)


def remove_terminal_gaps(components: DataFrame, gaps: DataFrame | None, terminal: Column | None = None, before: Column | None = None) -> DataFrame:
    """Without components whose gap joins a segment to itself. Where the rows of a path, numbered from 1 without holes, know whether they are
    ``terminal`` and how many such rows stand ``before`` them, the gaps need not be given and nothing is shuffled."""
    if terminal is not None and before is not None:
        return components.filter(~terminal).withColumn("ord", F.col("ord") - before)
    own = gaps.filter("s1 = s2").select(F.col("header").alias("__gap"))
    kept = components.join(own, (F.col("comp") == F.col("__gap")) & (F.col("ctype") == GAP), "left_anti")
    return renumber(kept)


def rename(components: DataFrame, old: str, new: str) -> DataFrame:
    return components.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


# -- gaps -------------------------------------------------------------------------------------------


def gaps_of(gaps: DataFrame, one: str, other: str | None = None) -> DataFrame:
    """Gaps at one segment, or between two, in whatever order."""
    if other is None:
        return gaps.filter((F.col("s1") == one) | (F.col("s2") == one))
    return gaps.filter(((F.col("s1") == one) & (F.col("s2") == other)) | ((F.col("s1") == other) & (F.col("s2") == one)))


def remove_gaps(components: DataFrame, gaps: DataFrame, one: str, other: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Components and gaps without the gaps at a segment, or between two; none there is an error."""
    gone = gaps_of(gaps, one, other).select(F.col("header").alias("__gone"))
    if gone.isEmpty():
        raise ValueError(f"no gap at {one}" + (f" and {other}" if other else ""))
    kept = components.join(gone, (F.col("comp") == F.col("__gone")) & (F.col("ctype") == GAP), "left_anti")
    return renumber(kept).select(*components.columns), gaps.join(gone, F.col("header") == F.col("__gone"), "left_anti")


# -- order ------------------------------------------------------------------------------------------


def by_name(paths: DataFrame, descending: bool = False) -> DataFrame:
    return paths.orderBy(F.desc("header") if descending else F.asc("header"))


def by_original(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*(columns or ("seq_pos",)))


def by_size(paths: DataFrame, largest: bool = True, compat: bool = False) -> DataFrame:
    """Needs ``length``. compat: with the largest-first switch shorter paths come first."""
    down = largest != compat
    return paths.orderBy(F.desc("length") if down else F.asc("length"), "header")


def by_list(paths: DataFrame, names: list[str]) -> DataFrame:
    """In the list's order; a path missing from the list is an error."""
    order = paths.sparkSession.createDataFrame(list(enumerate(names)), "place long, header string")
    joined = paths.join(order, "header", "left")
    checked = joined.withColumn("place", F.when(F.col("place").isNull(), F.raise_error(F.concat(F.lit("not in the list: "), "header"))).otherwise(F.col("place")))
    return checked.orderBy("place").select(*paths.columns)


def argsort(values: DataFrame, value: str, position: str, largest: bool = False) -> DataFrame:
    """Stable ranks: (position, rank). Rows are range-partitioned in order; ranks are those inside a partition plus the rows of the
    partitions before it."""
    order = [F.desc(value) if largest else F.asc(value), F.asc(position)]
    spark = values.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = Rounds(spark, keep=1 << 30)
    dealt = store.write(values.select(value, position).repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.select("__part", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return dealt.join(F.broadcast(offsets), "__part").select(position, rank.alias("rank"))
