"""Cutting lineage in loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where neither is set and the master is local (tests, one machine) is a temporary folder made, once a session;
    on a cluster that is an error, as executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="contigua-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is run inside joins by shuffle alone: the small tables of many rounds would each pass through the driver."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Rounds:
    """Tables of an iteration, each written to the shared folder and read back.

    A written table has its true size as statistics. (A checkpoint keeps the estimate of its plan, and
    estimates of joins multiply: after some rounds they have millions of digits.) Tables of rounds before
    the last ``keep`` are deleted.
    """

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep = spark, keep
        self.root = f"{shared_root(spark)}/rounds-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > self.keep + 1:
            self.drop(self.paths[-self.keep - 2])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
