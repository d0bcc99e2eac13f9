"""k-mers: canonical counts, histograms, unions, minimisers and super-mers.

Reads are cut at letters that are not bases, and long stretches into chunks that overlap by k - 1, before
windows are made, so neither a window with such a letter nor a row with millions of windows ever exists.

Up to 31 bases a k-mer is a long of 2-bit codes: built for both strands by shifts over whole chunks (Arrow batches), counted in
the task, summed by Spark, and spelt out only once distinct. Minimisers and super-mers are found along a run
of bases where it lies, a chunk at a time with what the next one needs; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from contigua.functions import packing as P
from contigua.functions.seq import revcomp

MOST = 4_294_967_295
CHUNK = 10_000

#: Windows that a task makes at once; it holds the counts of twice as many, whatever its share of the reads.
HELD = 1 << 18


def stretches(reads: DataFrame, k: int, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, part, chunk_at, bases): upper-case runs of bases of at least k letters, in chunks."""
    runs = F.regexp_extract_all(F.upper(F.col(sequence)), F.lit("([ACGT]+)"), F.lit(1))
    rows = reads.select(*keep, F.posexplode(runs).alias("part", "run")).filter(F.length("run") >= k)
    starts = F.sequence(F.lit(0), F.length("run") - k, F.lit(CHUNK))
    return rows.select(*keep, "part", F.explode(starts).alias("chunk_at"), "run").select(*keep, "part", "chunk_at", F.expr(f"substring(run, chunk_at + 1, {CHUNK + k - 1})").alias("bases"))


def windows(reads: DataFrame, k: int, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, part, pos, kmer)."""
    rows = stretches(reads, k, sequence, keep)
    at = rows.select(*keep, "part", "chunk_at", "bases", F.explode(F.sequence(F.lit(1), F.length("bases") - k + 1)).alias("p"))
    return at.select(*keep, "part", (F.col("chunk_at") + F.col("p") - 1).alias("pos"), F.expr(f"substring(bases, p, {k})").alias("kmer"))


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
_BASE = np.frombuffer(b"ACGT", np.uint8)


def canonical_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Of each window of k 2-bit codes the lesser of it and its reverse complement, first base highest."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    wide = codes.astype(np.int64)
    there, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        part = wide[i : i + n]
        there = (there << 2) | part
        back |= (3 - part) << (2 * i)
    return np.minimum(there, back)


def base_runs(sequence: bytes, least: int) -> Iterator[np.ndarray]:
    """The codes of each run of at least ``least`` bases."""
    codes = _CODE[np.frombuffer(sequence, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], codes > 3, [True])).astype(np.int8)))
    for a, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if e - a >= least:
            yield codes[a:e]


def spelt(codes: np.ndarray, k: int) -> pa.Array:
    """The letters of k-mers."""
    letters = np.empty((len(codes), k), np.uint8)
    for i in range(k):
        letters[:, i] = _BASE[(codes >> (2 * (k - 1 - i))) & 3]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, k * (len(codes) + 1), k, dtype=np.int32)), pa.py_buffer(letters)])


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their times."""
    by = np.argsort(codes, kind="stable")
    codes = codes[by]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else by
    return codes[first], np.add.reduceat(times[by], first) if len(first) else times


def counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(code, cnt) of a task's texts, summed as far as it holds them; a long text is sent on in parts too."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        codes, times = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in summed(codes, times)], names=["code", "cnt"])

    size = 0
    for batch in batches:
        for text in batch.column(0):
            for run in base_runs(text.as_py() or b"", k):
                for at in range(0, len(run) - k + 1, HELD):
                    held.append(np.unique(canonical_codes(run[at : at + HELD + k - 1], k), return_counts=True))
                    size += len(held[-1][0])
                    if size > 2 * HELD:
                        yield merged()
                        held, size = [], 0
    if held:
        yield merged()


def count_kmers(reads: DataFrame, k: int = 21, sequence: str = "sequence") -> DataFrame:
    """(kmer, cnt) of canonical k-mers, saturating at 2**32 - 1."""
    if k > 31:
        return windows(reads, k, sequence).groupBy(P.canonical(F.col("kmer")).alias("kmer")).agg(F.least(F.count(F.lit(1)), F.lit(MOST)).alias("cnt"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([spelt(batch.column(0).to_numpy(), k), batch.column(1)], names=["kmer", "cnt"])

    counts = reads.select(F.col(sequence).cast("binary")).mapInArrow(lambda batches: counted(batches, k), "code long, cnt long").groupBy("code").agg(F.least(F.sum("cnt"), F.lit(MOST)).alias("cnt"))
    return counts.mapInArrow(spell, "kmer string, cnt long")


def histogram(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy(F.col("cnt").alias("freq")).agg(F.count(F.lit(1)).alias("n_kmers"))


def db_stats(hist: DataFrame, k: int) -> DataFrame:
    """(total, distinct_kmers, unique_kmers, missing); missing is null where 4**k passes a long."""
    return hist.agg(
        F.coalesce(F.sum(F.col("freq") * F.col("n_kmers")), F.lit(0)).alias("total"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("distinct_kmers"),
        F.coalesce(F.sum(F.when(F.col("freq") == 1, F.col("n_kmers"))), F.lit(0)).alias("unique_kmers"),
    ).withColumn("missing", F.lit(4**k if k <= 31 else None).cast("long") - F.col("distinct_kmers"))


def union(*dbs: DataFrame) -> DataFrame:
    """Multiset union with saturating sums."""
    out = dbs[0]
    for db in dbs[1:]:
        out = out.unionByName(db)
    return out.groupBy("kmer").agg(F.least(F.sum("cnt"), F.lit(MOST)).alias("cnt"))


def write_db(kmers: DataFrame, path: str, k: int) -> None:
    kmers.write.mode("overwrite").parquet(f"{path}/kmers")
    kmers.sparkSession.createDataFrame([(k,)], "k int").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def read_db(spark, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/kmers"), spark.read.parquet(f"{path}/index").first().k


# -- databases in buckets -----------------------------------------------------------------------------


def _bucketed_table(spark, path: str) -> str:
    """The name under which the session knows the files of a database, with their buckets."""
    path = path.rstrip("/")
    name = f"kmers_{hashlib.md5(path.encode()).hexdigest()}"
    index = spark.read.parquet(f"{path}/index").first()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (kmer STRING, cnt BIGINT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {index.buckets} BUCKETS LOCATION '{path}/kmers'")
    return name


def write_bucketed(kmers: DataFrame, path: str, k: int, buckets: int = 64) -> None:
    """A database whose files are buckets of k-mers by hash, each sorted; databases of as many buckets are united without a shuffle."""
    spark, path = kmers.sparkSession, path.rstrip("/")
    name = f"kmers_{hashlib.md5(path.encode()).hexdigest()}"
    own = kmers.select("kmer", F.col("cnt").cast("long").alias("cnt")).repartition(buckets, "kmer")
    own.write.bucketBy(buckets, "kmer").sortBy("kmer").option("path", f"{path}/kmers").mode("overwrite").saveAsTable(name)
    spark.createDataFrame([(k, buckets)], "k int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def read_bucketed(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(kmer, cnt) of a database, or of its buckets ``first`` to ``last`` alone; other files are not opened."""
    if first is None:
        return spark.table(_bucketed_table(spark, path))
    names = ",".join(f"{b:05d}" for b in range(first, last + 1))
    return spark.read.schema("kmer string, cnt long").option("pathGlobFilter", f"*_{{{names}}}.c*").parquet(f"{path.rstrip('/')}/kmers")


def union_bucketed(spark, *paths: str) -> DataFrame:
    """Multiset union of databases, bucket by bucket: merge joins of files that are sorted and dealt alike already."""
    shapes = {(r.k, r.buckets) for p in paths for r in [spark.read.parquet(f"{p.rstrip('/')}/index").first()]}
    if len(shapes) != 1:
        raise ValueError(f"databases of one k and one number of buckets are needed, not {sorted(shapes)}")
    out = read_bucketed(spark, paths[0])
    for p in paths[1:]:
        other = read_bucketed(spark, p).select("kmer", F.col("cnt").alias("more"))
        out = out.hint("merge").join(other, "kmer", "full").select("kmer", F.least(F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0)), F.lit(MOST)).alias("cnt"))
    return out


def smer_hash(smer: Column, filtered: bool = False) -> Column:
    own = P.canonical(smer)
    return P.filtered_hash(own) if filtered else P.code(own)


def _hashes(codes: np.ndarray, s: int, filtered: bool) -> np.ndarray:
    """What ``smer_hash`` gives for each canonical s-mer."""
    own = canonical_codes(codes, s)
    if filtered:
        digit = lambda i: (own >> (2 * (s - 1 - i))) & 3 if 0 <= i < s else np.zeros(len(own), np.int64)
        pad = max(0, 5 - s)  # shorter ones count as padded in front with A
        at = [digit(i - pad) for i in range(5)]
        a = [x == 0 for x in at]
        bad = (a[0] & a[2] & (a[1] | (at[1] == 1))) | (a[1] & a[2]) | (a[2] & a[3]) | (a[3] & a[4])
        own = np.where(bad, 65535, own)
    return own


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _along_runs(reads: DataFrame, k: int, s: int, sequence: str, keep: tuple[str, ...], filtered: bool, find, columns: tuple[str, ...], hashes=None) -> DataFrame:
    """(*keep, part, *columns) by ``find(minima of a chunk's k-mers, minimum before or None, place of the first, whether it is the last, state)``,
    called along each run of at least k bases; ``state`` is a dictionary of the run. ``hashes`` may give the s-mers other values."""
    own = reads.select(*keep, F.col(sequence).cast("binary").alias("__s")).filter(F.length("__s") >= k)
    schema = StructType(own.schema.fields[: len(keep)]).add("part", "integer")
    for c in columns:
        schema = schema.add(c, "boolean" if c.startswith("is_") else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            size = 0

            def rows() -> pa.RecordBatch:
                row, *cols = (np.concatenate(c) for c in zip(*parts))
                kept = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *map(pa.array, cols)], names=[*keep, "part", *columns])

            for i, text in enumerate(batch.column(len(keep))):
                for part, codes in enumerate(base_runs(text.as_py() or b"", k)):
                    before, state = None, {}
                    for at in range(0, len(codes) - k + 1, 1 << 18):
                        piece = codes[at : at + (1 << 18) + k - 1]
                        minima = sliding_minimum(hashes(piece) if hashes else _hashes(piece, s, filtered), k - s + 1)
                        out = find(minima, before, at, at + len(piece) == len(codes), state)
                        n = len(out[0])
                        parts.append([np.full(n, i), np.full(n, part, np.int32), *out])
                        before, size = minima[-1], size + n
                        if size > 1 << 18:
                            yield rows()
                            parts, size = [], 0
            if parts:
                yield rows()

    return own.mapInArrow(run, schema)


def _new(minima: np.ndarray, before: int | None) -> np.ndarray:
    return np.concatenate(([before is None or minima[0] != before], minima[1:] != minima[:-1]))


def minimisers(reads: DataFrame, k: int, s: int, sequence: str = "sequence", keep: tuple[str, ...] = ("header",), filtered: bool = False) -> DataFrame:
    """(*keep, part, pos, h, is_new): of each k-mer the least hash of its canonical s-mers; is_new where it
    differs from that of the k-mer before. A run of bases is the unit, so runs never mix."""
    most = 4**s + 1

    def find(minima, before, at, last, state):
        new = _new(minima, before)
        return [np.arange(at, at + len(minima)), minima, new & (minima < most) if filtered else new]

    return _along_runs(reads, k, s, sequence, keep, filtered, find, ("pos", "h", "is_new"))


def supermers(reads: DataFrame, k: int, s: int, sequence: str = "sequence", keep: tuple[str, ...] = ("header",), filtered: bool = False) -> DataFrame:
    """(*keep, part, start, length, h): maximal stretches of k-mers with one minimiser, as bases."""

    def find(minima, before, at, last, state):
        begins = np.flatnonzero(_new(minima, before)) + at
        starts = np.concatenate((state.get("open", np.zeros(0, np.int64)), begins))
        values = np.concatenate((state.get("h", np.zeros(0, np.int64)), minima[begins - at]))
        ends = np.append(starts[1:], at + len(minima))
        if not last:  # the last stretch may go on
            state["open"], state["h"] = starts[-1:], values[-1:]
            starts, values, ends = starts[:-1], values[:-1], ends[:-1]
        return [starts, ends - starts + k - 1, values]

    return _along_runs(reads, k, s, sequence, keep, filtered, find, ("start", "length", "h"))


def minimiser_hex(mins: DataFrame, keep: tuple[str, ...] = ("header",)) -> DataFrame:
    """Per run of bases the hexadecimal minimisers, concatenated in order."""
    own = F.array_sort(F.collect_list(F.struct("pos", P.dec_to_hexa(F.col("h")).alias("x"))))
    return mins.groupBy(*keep, "part").agg(F.array_join(F.transform(own, lambda e: e["x"]), "").alias("hex"))


def least_minimiser(reads: DataFrame, s: int, sequence: str = "sequence", keep: tuple[str, ...] = ("header",), filtered: bool = False) -> DataFrame:
    def find(minima, before, at, last, state):
        return [np.array([minima.min()])]

    return _along_runs(reads, s, s, sequence, keep, filtered, find, ("h",)).groupBy(*keep).agg(F.min("h").alias("h"))


def walk_alternatives(alternatives: Column) -> Column:
    """All strings that take one alternative of each place, in order: array<array<string>> to array<string>."""
    return F.aggregate(alternatives, F.array(F.lit("")), lambda acc, a: F.flatten(F.transform(acc, lambda p: F.transform(a, lambda b: F.concat(p, b)))))
