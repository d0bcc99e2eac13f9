"""Sharding by size-tiered compaction over immutable Parquet shards and a versioned manifest.

``append`` writes what arrives as it lies: each task's rows become one small immutable shard, nothing is
shuffled. ``compact`` groups the live shards by tier (powers of ``ratio`` of their bytes), walks each tier
in order of size, closes a group whenever ``target_bytes`` are reached, and rewrites groups of at least
``fan_in`` shards as files of about that size; shards already at the target, and remainders, stay.

A version is a manifest, a folder ``manifest/<id>`` with the list of live shards, and becomes the newest by the creation of the
one small file ``versions/<n>`` that names it. That creation never overwrites, so of two writers one fails; it reads the newest
version and tries again (an append adds its shards to whatever is live, a compaction starts over if a shard it merged has gone). On a local
file system, whose ``create`` looks before it opens, the file is written aside and gets its name by a hard link, which fails if the name is there;
elsewhere the store's own exclusive ``create`` is relied on. A writer reads its file again before it counts its version as committed.
Readers see the old or the new list, never a mixture. Shards that no version lists are left for ``vacuum``, which spares
folders younger than ``grace`` seconds, as a writer may be about to commit them.

DataFrame functions only. Merging deals rows by the dense number of their group, one task a group or more: a group is bounded by
``target_bytes`` plus one shard, so no key grows with the input. Only live shards are read, by their paths.

Defined results: any columns and values, nulls included, pass through; repeated rows stay repeated; texts of any length stay whole (a row
is in one file); shards of equal size are taken in order of their paths; an empty table appends no shard; compacting what is
compact commits nothing; the columns ``__merge_group`` and ``__path`` are the store's own, and an error in the data.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from contigua.llm.common import scratch, sized, stored

#: Names that no column of the data may have.
GROUP, PATH = "__merge_group", "__path"
#: Seconds after which a version's file without content is a dead writer's.
DEAD = 60
COLUMNS = "path string, bytes long, n_rows long, tier int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("versions", "manifest", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # -- versions -------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        files = self._fs.listStatus(self._path(f"{self.root}/versions"))
        return max((int(s.getPath().getName()) for s in files if s.getLen() and s.getPath().getName().isdigit()), default=0)

    def _manifest_of(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(f"{self.root}/manifest/{self._manifest_of(version)}")

    def _commit(self, live: DataFrame, base: int) -> int | None:
        """The version after ``base`` with these shards; none if another writer was first."""
        name = uuid.uuid4().hex
        live.select(*[c.split()[0] for c in COLUMNS.split(", ")]).coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        try:
            self._claim(base + 1, name)
            if self._manifest_of(base + 1) == name:
                return base + 1
        except Py4JJavaError as e:
            kind, text = e.java_exception.getClass().getName(), str(e.java_exception.getMessage())
            if not any(x in kind or x.lower() in text for x in ("Exist", "FileNotFound", "NoSuchFile")):
                raise
        self._fs.delete(self._path(f"{self.root}/manifest/{name}"), True)
        self._clear_dead(base + 1)
        return None

    def _claim(self, version: int, name: str) -> None:
        """Makes the version's file; an error if it is there."""
        own = self._path(f"{self.root}/versions/{version}")
        if self._fs.getScheme() != "file":
            stream = self._fs.create(own, False)
            try:
                stream.write(bytearray(name.encode()))
            finally:
                stream.close()
            return
        jvm = self.spark.sparkContext._jvm
        where = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        aside = where(self._path(f"{self.root}/versions/_{name}"))
        jvm.java.nio.file.Files.write(aside, bytearray(name.encode()), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        try:
            jvm.java.nio.file.Files.createLink(where(own), aside)
        finally:
            jvm.java.nio.file.Files.delete(aside)

    def _clear_dead(self, version: int) -> None:
        """Takes away the file of a writer that died between making it and naming its manifest in it."""
        path = self._path(f"{self.root}/versions/{version}")
        if self._fs.exists(path):
            status = self._fs.getFileStatus(path)
            if not status.getLen():
                time.sleep(0.1)
                if status.getModificationTime() < (time.time() - DEAD) * 1000:
                    self._fs.delete(path, False)

    # -- shards ---------------------------------------------------------------------------------

    def _new_folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _shards(self, folder: str, ratio: int) -> DataFrame:
        """(path, bytes, n_rows, tier) of the files in a folder; only footers are read. Written once, as a commit may be tried again."""
        files = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n_rows"))
        return stored(files.withColumn("tier", F.floor(F.log(F.greatest("bytes", F.lit(1))) / F.log(F.lit(float(ratio)))).cast("int")))

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schema").first()[0]))

    def append(self, rows: DataFrame, ratio: int = 4) -> int:
        """The rows as small shards, one a task, and a new version with them."""
        clash = {GROUP, PATH} & set(rows.columns)
        if clash:
            raise ValueError(f"the data have columns of the store's own: {sorted(clash)}")
        if self.version() == 0 and not self._fs.exists(self._path(f"{self.root}/schema")):
            self.spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema")
        folder = self._new_folder()
        rows.write.option("compression", "zstd").parquet(folder)
        found = self._shards(folder, ratio)
        while True:
            base = self.version()
            done = self._commit(self.manifest(base).unionByName(found), base)
            if done is not None:
                return done

    def plan(self, target_bytes: int, fan_in: int, version: int | None = None) -> DataFrame:
        """(path, bytes, __merge_group) of the live shards that a compaction would merge; groups are numbered from 0. A row a shard."""
        small = self.manifest(version).filter(F.col("bytes") < target_bytes)
        by_size = Window.partitionBy("tier").orderBy("bytes", "path")
        before = F.coalesce(F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        grouped = small.withColumn("place", F.floor(before / target_bytes))
        full = grouped.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier", "place"))).filter(F.col("n") >= fan_in)
        return full.select("path", "bytes", (F.dense_rank().over(Window.orderBy("tier", "place")) - 1).cast("int").alias(GROUP))

    def compact(self, target_bytes: int = 128 << 20, fan_in: int = 4, ratio: int = 4) -> int:
        """One round of merging; the version that it made, or the newest where there was nothing to merge."""
        while True:
            base = self.version()
            merge = stored(self.plan(target_bytes, fan_in, base))
            groups = merge.agg(F.coalesce(F.max(GROUP) + 1, F.lit(0))).first()[0]
            if not groups:
                return base
            folder = self._new_folder()
            paths = [r.path for r in merge.select("path").collect()]  # names of files, as those of any folder that Spark reads
            rows = self._rows(paths).join(sized(merge.select(F.col("path").alias(PATH), GROUP), 512), PATH).drop(PATH)
            dealt = rows.repartitionById(groups, F.col(GROUP)) if hasattr(rows, "repartitionById") else rows.repartitionByRange(groups, GROUP)
            dealt.write.partitionBy(GROUP).option("compression", "zstd").parquet(folder)
            found = self._shards(folder, ratio)
            while self.manifest(base).join(merge, "path", "left_semi").count() == len(paths):
                done = self._commit(self.manifest(base).join(merge, "path", "left_anti").unionByName(found), base)
                if done is not None:
                    return done
                base = self.version()  # another writer was first; if all that was merged is still live, only the list has to be made anew

    def _rows(self, paths: list[str]) -> DataFrame:
        """The rows of these files with the file of each, as ``__path``."""
        schema = self.schema()
        if not paths:
            return self.spark.createDataFrame([], schema.add(PATH, "string"))
        return self.spark.read.schema(schema).parquet(*paths).select(*schema.names, F.col("_metadata.file_path").alias(PATH))

    def read(self, version: int | None = None, with_path: bool = False) -> DataFrame:
        """The rows of a version; with_path: and the shard of each, as ``__path``."""
        found = self._rows([r.path for r in self.manifest(version).select("path").collect()])
        return found if with_path else found.drop(PATH)

    def vacuum(self, keep: int = 1, grace: float = 86_400) -> None:
        """Drops versions older than the last ``keep``, and manifests and data folders that none of the rest name and that are older
        than ``grace`` seconds."""
        last = self.version()
        manifests, data = set(), set()
        for v in range(max(1, last - keep + 1), last + 1):
            manifests.add(self._manifest_of(v))
            data |= {r.f for r in self.manifest(v).select(F.regexp_extract("path", r"/data/([^/]+)/", 1).alias("f")).distinct().collect()}
        for name in self._names("versions"):
            if name.isdigit() and int(name) <= last - keep:
                self._fs.delete(self._path(f"{self.root}/versions/{name}"), False)
        for folder, used in (("manifest", manifests), ("data", data)):
            for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                if s.getPath().getName() not in used and s.getModificationTime() < (time.time() - grace) * 1000:
                    self._fs.delete(s.getPath(), True)


def shard(docs: DataFrame, id_col: str = "doc_id", lots: int = 4, target_bytes: int = 16 << 20, fan_in: int = 2) -> DataFrame:
    """The rows arrive in ``lots`` appends, by hash of the id, and are compacted; per row: id, ``shard``,
    ``shard_bytes``, ``version``, ``merged`` (whether the shard is the compaction's).

    Of more shards below the target than tiers two at least are of one tier, so four appends of about one size, even of one file each, are always merged.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch(spark, "shards"))
    lot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(lots))
    for i in range(lots):
        store.append(docs.filter(lot == i))
    arrived = store.manifest().select(F.col("path").alias("as_it_came"))
    version = store.compact(target_bytes, fan_in)
    live = store.manifest(version).select(F.col("path").alias("of"), F.col("bytes").alias("shard_bytes"), F.substring_index("path", "/data/", -1).alias("shard"))
    live = live.join(arrived, F.col("of") == F.col("as_it_came"), "left").withColumn("merged", F.col("as_it_came").isNull())
    rows = store.read(version, with_path=True).select(id_col, PATH)
    return rows.join(live, F.col(PATH) == F.col("of")).select(id_col, "shard", "shard_bytes", F.lit(version).cast("long").alias("version"), "merged")
