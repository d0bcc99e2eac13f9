"""The corpus pipeline: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the
shared folder and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contigua.llm import compaction, decontaminate, kneser_ney, mixing, simhash
from contigua.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return kneser_ney.keep_good(docs, kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8) stays."""
    return simhash.keep_one(docs, shingle=5, radius=24, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are written as compacted shards; each with its shard."""
    return compaction.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding),
]

#: Fingerprints, n-gram models and physical shards are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
