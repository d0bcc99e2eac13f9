"""Sequences in chunks against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from contigua.operators import chunks, ingest


def made(rng, n):
    return "".join(rng.choice(["ACGTacgt"[rng.randrange(8)], "NNN", "nX", "AAAA", "c" * 9]) for _ in range(n))


RECORDS = [("h1", "NNACGTNNNaCcnGTAXX"), ("all", "N" * 50), ("none", ""), ("hom", "A" * 100), ("é", "ACGé" * 9)]


@pytest.mark.parametrize("size", [1, 3, 60, 1000])
def test_runs_over_edges(spark, size):
    rng = random.Random(size)
    rec = spark.createDataFrame(RECORDS + [("big", made(rng, 300)), ("nul", None)], "header string, sequence string")
    own = chunks.from_records(rec, size).repartition(3)
    got = sorted((r.header, r.i, r.name, r.kind, r.len, r.a, r.c, r.g, r.t, r.lower) for r in chunks.features(own).collect())
    f = ingest.features(rec)
    whole = {(r.header, r.i): (r.name, r.kind, r.len, r.text) for r in f.collect()}
    count = lambda t, x: sum(t.count(c) for c in x)
    assert got == sorted((h, i, name, kind, n, *(count(t, x) for x in ("Aa", "Cc", "Gg", "Tt")), sum("a" <= c <= "z" for c in t)) for (h, i), (name, kind, n, t) in whole.items())
    for cutoff in (1, 3):
        assert sorted(map(tuple, chunks.homopolymer_bed(own, cutoff).collect())) == sorted(map(tuple, ingest.homopolymer_bed(rec.filter("sequence IS NOT NULL"), cutoff).collect()))


def test_fasta_in_splits(spark, tmp_path):
    """A file cut into splits far shorter than its records gives the records of the whole."""
    rng = random.Random(1)
    text = "; before any header\n>a one two\n" + "".join(made(rng, 5)[: rng.randint(0, 40)] + "\n" for _ in range(200)) + ">b\r\nACGT\r\n>empty\n>c x\nAC\n\nGT"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.fa").write_text(text)
    (tmp_path / "in" / "2.fa").write_text(">d\nTTTT\n")
    want = {}
    for name in ("1.fa", "2.fa"):
        for part in (tmp_path / "in" / name).read_text().replace("\r", "").split("\n>"):
            head, _, body = part.removeprefix(">").partition("\n")
            if not part.startswith(";"):
                want[head.partition(" ")[0]] = (head.partition(" ")[2], body.replace("\n", ""))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes") if spark.conf.get(k, None) is not None}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        rows = chunks.read_fasta(spark, str(tmp_path / "in"), 120).collect()
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
    got = {}
    for r in sorted(rows, key=lambda r: (r.place, r.chunk)):
        assert r.offset == 120 * r.chunk and len(r.bases) <= 120
        comment, bases = got.get(r.header, (r.comment, ""))
        assert len(bases) == r.offset
        got[r.header] = (comment, bases + r.bases)
    assert got == want and list(got) == list(want)
    out = spark.createDataFrame(rows)
    chunks.write_fasta(out, str(tmp_path / "out"), 60, 120)
    assert sorted(chunks.read_fasta(spark, str(tmp_path / "out"), 120, whole=True).drop("place").collect()) == sorted(out.drop("place").collect())
    lines = [len(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert max(lines) == 60
    with pytest.raises(ValueError):
        chunks.fasta_blocks(out, 50, 120)
    assert out.filter(F.col("bases") == "").select("header").collect()[0].header == "empty"


def test_runs_are_looked_for_in_many_chunks_at_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def labels(letters):
        calls.add(1)
        return letters.astype("int64")

    own = chunks.from_records(spark.createDataFrame([("h", "AACC" * 5000)], "header string, sequence string"), 10)
    got = sorted((r.number, r.start, r.end) for r in chunks._runs(own, labels).collect())
    assert got == [(i, 2 * i, 2 * i + 2) for i in range(10_000)] and 0 < calls.value < 20
