"""Views that read assemblies out of the driver's tables.

Sequences are the bases in a document's text; path components are the lines of an order, whose part is a
segment of p_size bases and whose quantity is the gap that follows; edges join a part to its successor in
the latest order that gives it one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec, functions as F

from contigua.model import GAP, SEGMENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(header, sequence): with gaps and soft-masking."""
    return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("header"), F.regexp_replace("text", "[^ACGTNacgtn]+", "").alias("sequence"))


def reads(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(header, sequence): bases only, upper case."""
    return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("header"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("sequence"))


def _in_order() -> WindowSpec:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _in_order()
    own = table(spark, sf_dir, "lineitem")
    return own.select(
        F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("q"), "l_shipdate",
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("orientation"), F.row_number().over(w).cast("long").alias("o"),
        F.lead("l_partkey").over(w).alias("next"), F.lead(F.when(F.col("l_returnflag") == "R", "-").otherwise("+")).over(w).alias("next_or"),
    )


def components(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Path components with len; ``held``: the lines, where they are written already."""
    rows = lines(spark, sf_dir) if held is None else held
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    segment = F.struct((F.col("o") * 2 - 1).alias("ord"), F.lit(SEGMENT).alias("ctype"), F.col("part").cast("string").alias("comp"), "orientation", zero.alias("start"), zero.alias("end"), F.col("size").alias("len"))
    gap = F.struct((F.col("o") * 2).alias("ord"), F.lit(GAP).alias("ctype"), F.concat_ws("_", F.lit("gap"), "path", "o").alias("comp"), F.lit("0").alias("orientation"), zero.alias("start"), zero.alias("end"), F.col("q").alias("len"))
    both = F.when(F.col("next").isNull(), F.array(segment)).otherwise(F.array(segment, gap))
    return rows.join(sizes, "part").select(F.col("path").cast("string").alias("path"), F.explode(both).alias("x")).select("path", "x.*")


def edges(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """One edge a part at most, so that the graph stays sparse; ``held``: the lines, where they are written already."""
    latest = Window.partitionBy("part").orderBy(F.desc("l_shipdate"), F.desc("path"), F.desc("o"))
    rows = (lines(spark, sf_dir) if held is None else held).filter("next IS NOT NULL").withColumn("r", F.row_number().over(latest)).filter("r = 1")
    return rows.select(F.concat_ws("_", F.lit("e"), "path", "o").alias("header"), F.col("part").alias("s1"), F.col("orientation").alias("s1_or"), F.col("next").alias("s2"), F.col("next_or").alias("s2_or"), F.concat("q", F.lit("M")).alias("cigar"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("len"))


def bubble_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first four lines as a bubble: line 1 to 2 and 3, both to 4."""
    w, way = _in_order(), F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10).alias("at"), way.alias("s1_or"), F.row_number().over(w).cast("long").alias("o"), F.lead(way, 1).over(w).alias("one"), F.lead(way, 2).over(w).alias("two")
    )
    ahead = lambda n, way: F.struct((F.col("at") + F.col("o") + n).alias("s2"), F.col(way).alias("s2_or"))
    to = F.when(F.col("o") == 1, F.array(ahead(1, "one"), ahead(2, "two"))).when(F.col("o") == 2, F.array(ahead(2, "two"))).when(F.col("o") == 3, F.array(ahead(1, "one")))
    return rows.filter("o <= 3").select((F.col("at") + F.col("o")).alias("s1"), "s1_or", F.explode(to).alias("x")).select("s1", "s1_or", "x.s2", "x.s2_or").filter("s2_or IS NOT NULL")


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of at most 25 bases."""
    small = nodes(spark, sf_dir).filter("len <= 25").select("node")
    return edges(spark, sf_dir).join(small.toDF("s1"), "s1", "left_semi").join(small.toDF("s2"), "s2", "left_semi")


def variants(feats: DataFrame) -> DataFrame:
    """Variants of segments: every 20 bases in turn a substitution of two alternatives, a deletion of two bases or an insertion of two."""
    at = feats.filter((F.col("kind") == SEGMENT) & (F.col("len") > 9)).select(F.col("name").alias("segment"), "text", "len", F.explode(F.sequence(F.lit(9).cast("long"), F.col("len") - 1, F.lit(20).cast("long"))).alias("pos"))
    base = F.substring("text", (F.col("pos") + 1).cast("int"), F.lit(1))
    row = lambda alt, vtype, n, text, score: F.struct(F.lit(alt).cast("long").alias("alt"), F.lit(vtype).alias("vtype"), F.lit(n).alias("ref_len"), text.alias("sequence"), score.cast("double").alias("score"))
    both = F.array(row(0, "SNV", 1, F.translate(base, "ACGTacgt", "TGCAtgca"), F.col("pos") % 7), row(1, "COM", 1, F.concat(base, base), F.col("pos") % 5))
    turn = F.col("pos") % 60
    rows = F.when(turn == 9, both).when(turn == 29, F.array(row(0, "DEL", 2, F.lit(""), F.lit(3)))).otherwise(F.array(row(0, "INS", 0, F.lit("GT"), F.lit(4))))
    held = at.filter((turn != 29) | (F.col("pos") + 2 <= F.col("len")))
    return held.select("segment", F.col("pos").alias("grp"), "pos", F.explode(rows).alias("v")).select("segment", "grp", "v.alt", "v.vtype", "v.ref_len", "pos", "v.sequence", "v.score")


def sites(reads: DataFrame) -> DataFrame:
    """Choices in reads: of each twelve places one with another base, one with none and one with two more."""
    bases = F.regexp_extract_all("sequence", F.lit("(?s)...(.)"), F.lit(1))  # every fourth, in one pass, so that no row of a place carries its sequence
    at = reads.select("header", F.posexplode(bases).alias("q", "base")).select("header", (F.col("q") * 4 + 3).alias("p"), "base")
    base = F.col("base")
    text = F.when(F.col("p") % 12 == 3, F.translate(base, "ACGT", "TGCA")).when(F.col("p") % 12 == 7, "").otherwise(F.concat(base, F.lit("GT")))
    return at.select("header", F.col("p").cast("long").alias("pos"), F.lit(1).alias("choice"), text.alias("text"))
