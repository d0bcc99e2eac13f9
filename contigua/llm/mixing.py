"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source's target is its weight's share of all words, stopped at ``max_repeat`` times the words it
has; what is cut off goes to the others by weight (water filling, solved in closed form over the table
of sources). A document's expected copies are target / source words. Within a source the documents
stand in order of size; expected copies are prefix-summed, one random offset is added, and a document
is emitted once for each integer boundary that its stretch crosses. Order by size makes the words taken,
not just the documents, come close to the target.

The prefix sum is in two levels: rows are range-partitioned by (source, size, id), so a source that
holds a third of all rows is spread over as many partitions; ranks inside a partition plus the counts of
the partitions before it give ranks in the source.

Defined results: null text counts as size 0; a null source is a source of its own, last in order; a
source without words has target 0; ties in size go by id; an empty table gives an empty result; other
columns are ignored. The offset comes from the source's name and ``seed``, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.llm.common import cut, once, shuffle_width, stored

WORDS = r"[^\x20\x09-\x0D]+"
OFFSET_STEPS = 1 << 30


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3) -> DataFrame:
    """From rows (source, size): per source ``source_size``, ``target``. One row a source is all it sorts in one task."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = total.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))).withColumn("most", F.col("source_size") * float(max_repeat))
    fills = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything).getField("level")
    return levels.withColumn("water", water).select("source", "source_size", F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("water") * F.col("weight"))).alias("target"))


def plan_mix(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """From rows (id, source, size): the same rows with ``source_size``, ``target``, ``copies``."""
    spark = sizes.sparkSession
    sizes = cut(sizes)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col(id_col)]
    dealt = cut(sizes.repartitionByRange(shuffle_width(spark), *order).withColumn("part", F.spark_partition_id()))
    here = dealt.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(sizes, weights, max_repeat)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    stretch = here.withColumn("before", before).join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("part").alias("s_part"), F.col("source").alias("s_source"), "before", "source_size", "target")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", id_col)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    place = F.col("rank") + F.col("before")
    return (
        ranked.join(stretch, (F.col("part") == F.col("s_part")) & F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("copies", (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).cast("long"))
        .select(id_col, "source", "size", "source_size", "target", "copies")
    )


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Rows are found again by a hash over all their columns; rows equal in all are interchangeable: one stands for all their copies.
    """
    hashes = [p for c in docs.columns for p in (F.col(c).isNull(), _hashable(docs, c))]
    marked = docs.withColumn("__h1", F.xxhash64(F.lit(1), *hashes)).withColumn("__h2", F.xxhash64(F.lit(2), *reversed(hashes)))
    keys = marked.select(F.struct(F.col(id_col), "__h1", "__h2").alias("key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    taken = plan_mix(keys, weights, max_repeat, seed, "key").groupBy("key.__h1", "key.__h2").agg(F.sum("copies").alias("__copies"))
    taken = stored(taken.filter("__copies > 0"))
    one = once(marked, "__h1", "__h2")
    return one.join(taken, ["__h1", "__h2"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


def _hashable(docs: DataFrame, c: str) -> Column:
    """Columns that hold maps are hashed as JSON."""
    return F.to_json(F.struct(F.col(c))) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c)
