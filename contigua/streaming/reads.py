"""Reads as they arrive: files of a folder in micro-batches, k-mer counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from contigua.operators import kmers


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of reads; the limit of files a batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def count_stream(reads: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """Running (kmer, cnt); its state is one row a k-mer."""
    return kmers.count_kmers(reads, k, sequence)


def count_to_db(reads: DataFrame, k: int, db: str, checkpoint: str, sequence: str = "sequence") -> StreamingQuery:
    """Each batch's counts are stored as a part of the database in ``db``; a batch that is run again writes the
    same part. ``merged_db`` sums the parts."""

    def store(batch: DataFrame, number: int) -> None:
        kmers.count_kmers(batch, k, sequence).write.mode("overwrite").parquet(f"{db}/batch={number}")

    return reads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_db(spark: SparkSession, db: str) -> DataFrame:
    return kmers.union(spark.read.parquet(db).select("kmer", "cnt"))
