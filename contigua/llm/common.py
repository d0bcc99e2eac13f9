"""Helpers that every training-data operator shares: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contigua.operators.lineage import Rounds, shared_root as _root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, one machine) is
    a temporary folder made, once per session.
    """
    root = _root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: like ``cut``, but Spark then knows the true size, and broadcasts the
    table in a join only below its own threshold."""
    return Rounds(df.sparkSession).write(df)


#: Rows times bytes a row up to which a stored table is sent to all tasks.
MOST_BROADCAST = 32 << 20


def sized(table: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A stored table, marked for broadcast if its rows of ``row_bytes`` are within MOST_BROADCAST; else joins shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= MOST_BROADCAST else table


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the rows that are equal in ``keys`` (columns without nulls). Only rows that do repeat are dealt anew with all
    their columns; for the others the keys alone are."""
    again = stored(rows.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    if again.isEmpty():
        return rows
    again = sized(again)
    return rows.join(again, list(keys), "left_anti").unionByName(rows.join(again, list(keys), "left_semi").dropDuplicates(list(keys)))


def row_key(*columns: Column) -> list[Column]:
    """``k1``, ``k2``: 128 bits that tell rows apart by the columns, nulls included."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("k2")]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns to the system what a Python worker's allocators hold but don't use; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
