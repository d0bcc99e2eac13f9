"""Minimiser orders trained on the reads, balanced buckets, and k-mer counting through super-mers.

An order puts rare m-mers first, so that no minimiser holds a large share of all k-mers. Frequencies and loads are counted in arrays of
4**m numbers a task (m is at most 10), so both come from one pass each and a sum. Minimisers are dealt to buckets
greedily, the heaviest to the lightest bucket; one that holds more than half a bucket's share is hot and has none: its k-mers are dealt by their own hash.

A k-mer's bucket is thus a function of its canonical form, and all copies of it, from either strand, meet in one bucket. Counting
sends each stretch of k-mers with one bucket as bases, two bits each, and expands and counts it where it arrives: a base instead of a
k-mer a place, and nothing is shuffled a second time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contigua.operators.kmers import MOST, _along_runs, _new, base_runs, canonical_codes, sliding_minimum, spelt, summed

#: Most bases that a task holds before it sends them on, and most k-mers that it counts at once.
HELD = 1 << 20
#: k-mers of a bucket on average where their number is not given: 16 bytes each, and some 64 while they are merged.
SHARE = 1 << 21
HOT = -1


@dataclass(frozen=True)
class Order:
    """``rank`` of each m-mer by its canonical code; ``bucket`` of each rank, HOT for those dealt k-mer by k-mer."""

    m: int
    rank: np.ndarray
    bucket: np.ndarray
    buckets: int


def _sums(reads: DataFrame, sequence: str, least: int, width: int, codes_of) -> DataFrame:
    """(code, n): how often each number below ``width`` occurs in ``codes_of(run of bases)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for codes in base_runs(text.as_py() or b"", least):
                    for at in range(0, len(codes) - least + 1, HELD):
                        total += np.bincount(codes_of(codes[at : at + HELD + least - 1]), minlength=width)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["code", "n"])

    own = reads.select(F.col(sequence).cast("binary"))
    return own.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def mmer_ranks(reads: DataFrame, m: int, sequence: str = "sequence") -> DataFrame:
    """(code, freq, rank): canonical m-mers of the reads, the rarest first, ties by code. ``code`` has two bits a base."""
    if not 1 <= m <= 10:
        raise ValueError("m must be from 1 to 10")
    counts = _sums(reads, sequence, m, 4**m, lambda codes: canonical_codes(codes, m)).collect()  # at most 4**m rows
    rows = [(r.code, r.n, i) for i, r in enumerate(sorted(counts, key=lambda r: (r.n, r.code)))]
    return reads.sparkSession.createDataFrame(rows, "code long, freq long, rank long")


def ranks(reads: DataFrame, m: int, sequence: str = "sequence") -> np.ndarray:
    """Rank by code; m-mers that training did not see come last, in order of code."""
    known = {r.code: r.rank for r in mmer_ranks(reads, m, sequence).collect()}
    rank = np.full(4**m, -1, np.int64)
    rank[list(known)] = list(known.values())
    unseen = np.flatnonzero(rank < 0)
    rank[unseen] = len(known) + np.arange(len(unseen))
    return rank


def train(reads: DataFrame, k: int, m: int, buckets: int, sample: int | None = None, sequence: str = "sequence", most: int | None = None) -> Order:
    """An order and its buckets from all reads, or from the ``sample`` of least hash; more buckets than asked for where those trained on would
    hold more than ``most`` k-mers on average."""
    if not m <= k <= 31:
        raise ValueError("k must be from m to 31")
    seen = reads.select(sequence)
    if sample is not None:
        seen = seen.orderBy(F.xxhash64(sequence)).limit(sample)
    rank = ranks(seen, m, sequence)
    sent = reads.sparkSession.sparkContext.broadcast(rank)  # 4**m numbers
    load = np.zeros(4**m, np.int64)
    for r in _sums(seen, sequence, k, 4**m, lambda codes: sliding_minimum(sent.value[canonical_codes(codes, m)], k - m + 1)).collect():
        load[r.code] = r.n
    if most is not None:
        buckets = max(buckets, -(-int(load.sum()) // most))
    bucket = np.arange(4**m, dtype=np.int64) % buckets  # where training saw nothing
    share = max(1, int(load.sum()) // (2 * buckets))
    room = [(0, b) for b in range(buckets)]
    for r in np.argsort(-load, kind="stable").tolist():
        n = int(load[r])
        if not n:
            break
        if n > share:
            bucket[r] = HOT
            continue
        held, b = room[0]
        bucket[r] = b
        heapq.heapreplace(room, (held + n, b))
    return Order(m, rank, bucket, buckets)


def _buckets(codes: np.ndarray, k: int, order: Order) -> np.ndarray:
    """The bucket of each k-mer of a run."""
    own = order.bucket[sliding_minimum(order.rank[canonical_codes(codes, order.m)], k - order.m + 1)]
    hot = own == HOT
    if hot.any():
        h = canonical_codes(codes, k)[hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own[hot] = ((h ^ (h >> np.uint64(32))) % np.uint64(order.buckets)).astype(np.int64)
    return own


def minimisers(reads: DataFrame, k: int, m: int, rank: np.ndarray, sequence: str = "sequence", keep: tuple[str, ...] = ("header",)) -> DataFrame:
    """(*keep, part, pos, rank, is_new): of each k-mer the least rank of its m-mers."""
    sent = reads.sparkSession.sparkContext.broadcast(rank)

    def find(minima, before, at, last, state):
        return [np.arange(at, at + len(minima)), minima, _new(minima, before)]

    return _along_runs(reads, k, m, sequence, keep, False, find, ("pos", "rank", "is_new"), lambda codes: sent.value[canonical_codes(codes, m)])


def packed(codes: np.ndarray) -> bytes:
    """Two bits a base, four bases a byte, the last byte filled with zeros."""
    whole = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    whole[: len(codes)] = codes
    four = whole.reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    four = np.frombuffer(raw, np.uint8)
    return np.stack([four >> 6, four >> 4 & 3, four >> 2 & 3, four & 3], 1).ravel()[:n]


def super_mers(reads: DataFrame, k: int, order: Order, sequence: str = "sequence") -> DataFrame:
    """(bucket, lengths, bases): stretches of k-mers of one bucket, many a row: their lengths as 32-bit numbers, and their bases packed."""
    sent = reads.sparkSession.sparkContext.broadcast(order)  # 2 * 4**m numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bucket and length of each stretch, and all their bases
        size = 0

        def sent_on() -> Iterator[pa.RecordBatch]:
            bucket, length, bases = (np.concatenate(c) for c in zip(*held))
            by = np.argsort(bucket, kind="stable")
            begins = np.cumsum(length) - length
            edges = np.flatnonzero(np.diff(bucket[by], prepend=-2))
            rows = []
            for a, e in zip(edges, [*edges[1:], len(by)]):
                own = by[a:e]
                n = length[own]
                at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((int(bucket[own[0]]), n.astype("<u4").tobytes(), packed(bases[at])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "lengths", "bases"])

        for batch in batches:
            for text in batch.column(0):
                for whole in base_runs(text.as_py() or b"", k):
                    for at in range(0, len(whole) - k + 1, HELD):
                        codes = whole[at : at + HELD + k - 1]
                        bucket = _buckets(codes, k, order)
                        begins = np.flatnonzero(np.diff(bucket, prepend=-2))
                        length = np.diff(np.append(begins, len(bucket))) + k - 1
                        at_ = np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(length.sum())
                        held.append((bucket[begins], length, codes[at_]))
                        size += int(length.sum())
                        if size > HELD:
                            yield from sent_on()
                            held, size = [], 0
        if held:
            yield from sent_on()

    return reads.select(F.col(sequence).cast("binary")).mapInArrow(run, "bucket int, lengths binary, bases binary")


def count_kmers(reads: DataFrame, k: int, m: int = 7, buckets: int | None = None, order: Order | None = None, sequence: str = "sequence") -> DataFrame:
    """(kmer, cnt) of canonical k-mers as ``kmers.count_kmers`` gives them, through super-mers.

    A bucket is counted in one task, which holds its distinct k-mers. ``buckets`` should be such that they fit; by default the number of shuffle
    partitions, or as many as hold some ``SHARE`` k-mers each, so that a task's memory does not grow with the reads.
    """
    width = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order or train(reads, k, m, buckets or width, sequence=sequence, most=None if buckets else SHARE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate(fresh), return_counts=True)
            return summed(np.concatenate([code, own]), np.concatenate([times, n]))

        for batch in batches:
            for lengths, bases in zip(batch.column(1), batch.column(2)):
                length = np.frombuffer(lengths.as_py(), "<u4").astype(np.int64)
                codes = canonical_codes(unpacked(bases.as_py(), int(length.sum())), k)
                within = np.ones(len(codes) + k - 1, bool)
                for back in range(1, k):  # windows that would cross into the next stretch
                    within[np.cumsum(length) - back] = False
                fresh.append(codes[within[: len(codes)]])
                size += len(fresh[-1])
                if size > HELD:
                    code, times = merged()
                    fresh, size = [], 0
        if fresh:
            code, times = merged()
        for at in range(0, len(code), 1 << 16):
            part = code[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([spelt(part, k), pa.array(np.minimum(times[at : at + (1 << 16)], MOST))], names=["kmer", "cnt"])

    stretches = super_mers(reads, k, order, sequence)
    return stretches.repartitionById(order.buckets, F.col("bucket")).mapInArrow(count, "kmer string, cnt long")
