"""Variants of segments, applied to paths or laid on them.

``variants``: segment, grp, alt, vtype (SNV, INS, DEL, COM), ref_len, pos (0-based on the segment), sequence, score. The alternatives
of a group replace the bases from its least pos on. ``placed``: components with their slice's text, start and len. A segment's groups
meet each place where it stands once, as one array, so a text is not repeated for each variant; groups that do not lie
wholly within a slice are left out (an insertion at its edge lies within), and so are segments without a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.functions.seq import revcomp
from contigua.model import SEGMENT


def _groups(variants: DataFrame) -> DataFrame:
    text = F.when(F.col("vtype") == "DEL", "").otherwise(F.coalesce("sequence", F.lit(""))).alias("text")
    best = F.max_by(F.struct("ref_len", text), F.struct("score", -F.col("alt")))
    # dealt by segment, as all that follows is by segment or within one: groups are not shuffled again
    return variants.repartition("segment").groupBy("segment", "grp").agg(
        F.min("pos").alias("at"), F.max("ref_len").alias("most"), F.max(F.col("vtype").isin("INS", "DEL")).alias("anchored"), F.round(F.avg("score"), 2).alias("q"),
        F.array_sort(F.collect_list(F.struct("alt", "ref_len", text))).alias("alts"), best.alias("best"),
    )


def _shift() -> Column:
    return F.when(F.col("start") == 0, 0).otherwise(F.col("start") - 1)


def _with_groups(placed: DataFrame, per_segment: DataFrame, size, how: str = "left") -> DataFrame:
    """``x``: the groups that lie within the slice; empty where there are none. ``how`` inner: without components that have no groups."""
    keyed = per_segment.withColumnRenamed("segment", "__seg")
    joined = placed.join(keyed, (F.col("comp") == F.col("__seg")) & (F.col("ctype") == SEGMENT), how).withColumn("__shift", _shift())
    inside = F.filter("x", lambda e: (e["at"] >= F.col("__shift")) & (e["at"] + size(e) <= F.col("__shift") + F.col("len")))
    return joined.withColumn("x", F.when(F.col("text").isNull() | F.col("x").isNull(), F.array().cast(joined.schema["x"].dataType)).otherwise(inside)).drop("__seg")


def apply(placed: DataFrame, variants: DataFrame) -> DataFrame:
    """The components with their text, and len, as the best alternative of each group makes it: the highest score, ties to the
    least alt. In order of (pos, bases replaced, grp) a group that begins before an earlier one of its segment ends is left
    out. Text stays that of the forward strand; ``sinks.path_sequences`` turns and joins. Returns path, ord, ctype, comp, orientation, start, end, len, text."""
    own = _groups(variants).select("segment", "grp", "at", F.col("best.ref_len").alias("n"), F.col("best.text").alias("text"))
    before = Window.partitionBy("segment").orderBy("at", "n", "grp").rowsBetween(Window.unboundedPreceding, -1)
    free = own.withColumn("until", F.max(F.col("at") + F.col("n")).over(before)).filter("until IS NULL OR at >= until")
    edits = free.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("at", "n", "grp", "text"))).alias("x"))
    rows = _with_groups(placed, edits, lambda e: e["n"]).withColumn("__b", F.col("text").cast("binary"))
    stop = lambda e: e["at"] + e["n"] - F.col("__shift")
    cut = lambda a, e: F.substring("__b", (a + 1).cast("int"), (e - a).cast("int")).cast("string")

    def piece(e: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(stop(F.get("x", i - 1)))
        return F.concat(cut(begin, e["at"] - F.col("__shift")), e["text"])

    rest = cut(stop(F.get("x", F.size("x") - 1)), F.col("len"))
    edited = F.when(F.size("x") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform("x", piece), ""), rest))
    rows = rows.select("path", "ord", "ctype", "comp", "orientation", "start", "end", F.col("len").alias("__len"), edited.alias("text"))
    return rows.select("path", "ord", "ctype", "comp", "orientation", "start", "end", F.when(F.col("ctype") == SEGMENT, F.coalesce(F.length("text").cast("long"), "__len")).otherwise(F.col("__len")).alias("len"), "text")


def on_paths(offsets: DataFrame, variants: DataFrame) -> DataFrame:
    """(path, ord, grp, pos, ref, alts, q): a row a group and place where its segment stands, on the path's strand; pos is
    1-based. Insertions and deletions are anchored on the base before, at the begin of a slice on the base after.

    ``offsets``: placed components with begin. Positions count components whole: overlaps of edges are not taken off.
    """
    per_segment = _groups(variants).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("at", "most", "grp", "anchored", "q", "alts"))).alias("x"))
    rows = _with_groups(offsets, per_segment, lambda e: e["most"], "inner").withColumn("__b", F.col("text").cast("binary"))
    minus = F.col("orientation") == "-"
    turn = lambda c: F.when(minus, revcomp(c)).otherwise(c)
    cut = lambda a, n: F.substring("__b", (a + 1).cast("int"), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int")).cast("string")

    def lay(e: Column) -> Column:
        a, n = e["at"] - F.col("__shift"), e["most"]
        core = cut(a, n)
        left = F.when(a > 0, cut(a - 1, 1)).otherwise("")
        right = F.when(a + n < F.col("len"), cut(a + n, 1)).otherwise("")
        before, after = turn(F.when(minus, right).otherwise(left)), turn(F.when(minus, left).otherwise(right))
        head = F.when(e["anchored"], before).otherwise("")
        tail = F.when(e["anchored"] & (before == ""), after).otherwise("")
        on = F.when(minus, F.col("len") - a - n).otherwise(a)
        alts = F.transform(e["alts"], lambda v: F.concat(head, turn(F.concat(v["text"], _rest(core, v["ref_len"]))), tail))
        return F.struct(e["grp"].alias("grp"), (F.col("begin") + on - F.length(head) + 1).alias("pos"), F.concat(head, turn(core), tail).alias("ref"), alts.alias("alts"), e["q"].alias("q"))

    return rows.select("path", "ord", F.explode(F.transform("x", lay)).alias("v")).select("path", "ord", "v.*")


def _rest(core: Column, taken: Column) -> Column:
    """What an alternative of fewer bases leaves of its group's."""
    return F.substring(core, taken + 1, F.length(core))
