"""Packed k-mers, minimisers and super-mers against models over strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigua.functions import packing as P, seq as S
from contigua.operators import kmers, minimiser_order

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def canonical(k):
    return min(k, k[::-1].translate(COMPLEMENT))


def code(k):
    return sum("ACGT".index(c) << 2 * (len(k) - 1 - i) for i, c in enumerate(k))


def smer_hash(s, filtered):
    own = canonical(s)
    padded = own.rjust(5, "A")
    bad = padded[:3] in ("AAA", "ACA") or any(padded[i : i + 2] == "AA" for i in (1, 2, 3))
    return 65535 if filtered and bad else code(own)


def model(seq, k, s, filtered):
    """(part, pos, h) of a sequence."""
    out, part = [], 0
    for run in "".join(c if c in "ACGT" else " " for c in seq.upper()).split():
        if len(run) >= k:
            h = [smer_hash(run[i : i + s], filtered) for i in range(len(run) - s + 1)]
            out += [(part, p, min(h[p : p + k - s + 1])) for p in range(len(run) - k + 1)]
            part += 1
    return out


@pytest.mark.parametrize("k", [1, 4, 21, 31, 33])
def test_counts(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGTacgtN", [9] * 8 + [1], k=300)) for _ in range(12)] + ["", None, "ACGT" * 40]
    expected = {}
    for t in texts:
        u = (t or "").upper()
        for i in range(len(u) - k + 1):
            if "N" not in u[i : i + k]:
                c = canonical(u[i : i + k])
                expected[c] = expected.get(c, 0) + 1
    got = kmers.count_kmers(spark.createDataFrame([(t,) for t in texts], "sequence string"), k)
    assert {r.kmer: r.cnt for r in got.collect()} == expected and got.columns == ["kmer", "cnt"]


@pytest.mark.parametrize("k, s, filtered", [(9, 4, False), (9, 4, True), (12, 7, True), (7, 7, False)])
def test_minimisers_and_supermers(spark, k, s, filtered, monkeypatch):
    rng = random.Random(k * s)
    texts = {f"r{i}": "".join(rng.choices("ACGTacgtN", [9] * 8 + [0.3], k=200)) for i in range(6)} | {"none": None, "short": "AC"}
    df = spark.createDataFrame(list(texts.items()), "header string, sequence string")
    mins = kmers.minimisers(df, k, s, filtered=filtered).collect()
    expected = {(name, *row) for name, t in texts.items() for row in model(t or "", k, s, filtered)}
    assert {(r.header, r.part, r.pos, r.h) for r in mins} == expected
    at = {(n, p, x): h for n, p, x, h in expected}
    for r in mins:
        assert r.is_new == (at.get((r.header, r.part, r.pos - 1)) != r.h and (not filtered or r.h < 4**s + 1))
    for r in kmers.supermers(df, k, s, filtered=filtered).collect():
        places = range(r.start, r.start + r.length - k + 1)
        assert all(at[r.header, r.part, x] == r.h for x in places)
        assert at.get((r.header, r.part, r.start - 1)) != r.h and at.get((r.header, r.part, places[-1] + 1)) != r.h
    least = {r.header: r.h for r in kmers.least_minimiser(df, s, filtered=filtered).collect()}
    assert least == {n: min(x) for n, t in texts.items() if (x := [h for _, _, h in model(t or "", s, s, filtered)])}


def test_chunks_of_a_long_run(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("ACGT", k=(1 << 18) * 2 + 500))
    df = spark.createDataFrame([("x", long)], "header string, sequence string")
    k, s = 21, 7
    mins = kmers.minimisers(df, k, s)
    n = mins.filter("is_new").count()
    found = kmers.supermers(df, k, s)
    assert mins.count() == len(long) - k + 1 and found.count() == n
    assert found.agg(F.sum(F.col("length") - k + 1)).first()[0] == len(long) - k + 1
    assert kmers.count_kmers(df, k).agg(F.sum("cnt")).first()[0] == len(long) - k + 1


def test_columns_agree_with_codes(spark):
    rows = [("ACGTACGTACG",), ("TTTTTTTTTTT",), ("GATTACAGATT",)]
    for r in spark.createDataFrame(rows, "k string").select("k", P.code(P.canonical(F.col("k"))).alias("c"), S.revcomp(F.col("k")).alias("r")).collect():
        assert r.c == code(canonical(r.k)) and r.r == r.k[::-1].translate(COMPLEMENT)


def _reads(spark, n=300, hot=True):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(20_000))
    comp = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(n):
        at = rng.randrange(len(genome) - 200)
        s = genome[at : at + rng.randint(10, 200)]
        rows.append((f"r{i}", s if i % 2 else s[::-1].translate(comp)))
    rows += [("n", "ACGTNNNNNACGTACGTACGTTTGACA"), ("e", ""), ("z", None), ("x", "acgtacgtTTGACAacgtacgtaaccgg")]
    if hot:
        rows += [(f"h{i}", "A" * 150) for i in range(n // 2)] + [(f"g{i}", "ACACACAC" * 15) for i in range(n // 2)]
    return spark.createDataFrame(rows, "header string, sequence string").repartition(5)


@pytest.mark.parametrize("k, m", [(9, 3), (21, 5), (31, 7)])
def test_count_through_super_mers(spark, k, m):
    """The same counts, with hot minimisers, and by an order trained on a sample."""
    reads = _reads(spark)
    want = sorted(map(tuple, kmers.count_kmers(reads, k).collect()))
    assert sorted(map(tuple, minimiser_order.count_kmers(reads, k, m, 6).collect())) == want
    order = minimiser_order.train(reads, k, m, 6)
    assert (order.bucket == minimiser_order.HOT).any()
    sampled = minimiser_order.train(reads, k, m, 6, sample=40)
    assert sorted(map(tuple, minimiser_order.count_kmers(reads, k, order=sampled).collect())) == want
    none = minimiser_order.count_kmers(reads.limit(0), k, m, 3)
    assert none.collect() == [] and none.dtypes == [("kmer", "string"), ("cnt", "bigint")]


def test_buckets_are_even(spark):
    """The largest bucket holds at most 1.3 times the mean."""
    reads, k = _reads(spark, 900, hot=False), 31
    order = minimiser_order.train(reads, k, 7, 8)
    stretches = minimiser_order.super_mers(reads, k, order).collect()
    load = [0] * 8
    for r in stretches:
        lengths = np.frombuffer(r.lengths, "<u4")
        load[r.bucket] += int((lengths - k + 1).sum())
        assert len(minimiser_order.unpacked(r.bases, int(lengths.sum()))) == lengths.sum()
    assert sum(load) == sum(max(0, len(r.sequence or "") - k + 1) for r in reads.collect() if "N" not in (r.sequence or "N"))
    assert max(load) <= 1.3 * sum(load) / 8


def test_super_mers_shuffle_less(spark):
    """At k = 31 the bases of super-mers are a quarter of the k-mers' longs at most."""
    rng = random.Random(9)
    rows = [("".join(rng.choice("ACGT") for _ in range(20_000)),) for _ in range(20)]
    reads = spark.createDataFrame(rows, "sequence string").repartition(4)
    written = lambda: sum(e.totalShuffleWrite() for e in _executors(spark))
    order = minimiser_order.train(reads, 31, 7, 4)
    reads = spark.createDataFrame(reads.collect()).coalesce(2)
    a = written()
    n = kmers.count_kmers(reads, 31).count()
    b = written()
    assert minimiser_order.count_kmers(reads, 31, order=order).count() == n
    c = written()
    assert 4 * (c - b) <= b - a


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return [found.apply(i) for i in range(found.size())]


def test_bucketed_databases(spark, tmp_path):
    """United without a shuffle; a range of buckets is those buckets' files."""
    a, b = _reads(spark, 60), _reads(spark, 90, hot=False)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    kmers.write_bucketed(kmers.count_kmers(a, 13), one, 13, 8)
    kmers.write_bucketed(kmers.count_kmers(b, 13), two, 13, 8)
    got = kmers.union_bucketed(spark, one, two)
    want = sorted(map(tuple, kmers.union(kmers.count_kmers(a, 13), kmers.count_kmers(b, 13)).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = kmers.union_bucketed(spark, one, two)
        assert sorted(map(tuple, got.collect())) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    whole = sorted(map(tuple, kmers.count_kmers(a, 13).collect()))
    parts = [sorted(map(tuple, kmers.read_bucketed(spark, one, first, last).collect())) for first, last in ((0, 2), (3, 3), (4, 7))]
    assert sorted(r for p in parts for r in p) == whole and all(parts)
    assert kmers.read_bucketed(spark, one, 0, 2).filter(F.expr("pmod(hash(kmer), 8) NOT IN (0, 1, 2)")).count() == 0
    spark.sql(f"DROP TABLE {kmers._bucketed_table(spark, one)}")  # another session knows the files by their path alone
    assert sorted(map(tuple, kmers.read_bucketed(spark, one).collect())) == whole
    kmers.write_bucketed(kmers.count_kmers(a, 13), one, 13, 4)
    with pytest.raises(ValueError, match="number of buckets"):
        kmers.union_bucketed(spark, one, two)


def test_counts_are_sent_on_within_a_long_text():
    """A task holds a bounded number of k-mers however long a text is."""
    import pyarrow as pa

    text = np.random.default_rng(3).choice(np.frombuffer(b"ACGT", np.uint8), 1_500_000).tobytes()
    sizes, total = [], 0
    for part in kmers.counted(iter([pa.RecordBatch.from_arrays([pa.array([text, None])], names=["s"])]), 21):
        sizes.append(part.num_rows)
        total += sum(part.column("cnt").to_pylist())
    assert total == len(text) - 20 and max(sizes) <= 3 * kmers.HELD


def test_buckets_grow_with_reads(spark):
    """Without a number given, a bucket's k-mers stay bounded and counts are those of one bucket."""
    rng = random.Random(8)
    reads = spark.createDataFrame([("".join(rng.choices("ACGT", k=500)),) for _ in range(40)], "sequence string")
    order = minimiser_order.train(reads, 21, 7, 4, most=1000)
    assert order.buckets == -(-40 * 480 // 1000)
    assert sorted(minimiser_order.count_kmers(reads, 21, order=order).collect()) == sorted(kmers.count_kmers(reads, 21).collect())
