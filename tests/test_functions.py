"""Scalar functions against worked examples and inverse properties."""

import random

import pytest
from pyspark.sql import functions as F

from contigua.functions import packing as P, seq as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(s):
    return F.lit(s)


def test_worked_examples(spark):
    assert value(spark, S.revcomp(lit("AaNCg"), strict=True)) == "cGNtT"
    assert value(spark, S.cigar_match(lit("12M"))) == 12
    assert tuple(value(spark, S.parse_coordinate(lit("chr:1:5-9")))) == ("chr:1", 5, 9)
    assert tuple(value(spark, S.parse_coordinate(lit("chr1")))) == ("chr1", 0, 0)
    assert value(spark, S.compress(lit("AACCCGTTA"))) == "ACGTA"
    assert [tuple(r) for r in value(spark, S.run_bed(lit("AACCCGTTA")))] == [(0, 2), (2, 5), (6, 8)]
    assert [tuple(r) for r in value(spark, S.run_bed(lit("AACCCGTTA"), compressed=True))] == [(0, 2), (1, 4), (3, 5)]
    assert value(spark, S.homopolymer_runs(lit("AACCCGTTA"))) == 3
    assert value(spark, S.slice_1(lit("ACGTA"), lit(2), lit(4))) == "CGT" and value(spark, S.slice_1(lit("ACGTA"), lit(0), lit(0))) == "ACGTA"
    assert value(spark, S.erase_interval(lit("ACGTA"), lit(1), lit(3))) == "ATA"
    assert value(spark, S.text_wrap(lit("ACGTA"), 2)) == "AC\nGT\nA"
    assert value(spark, S.file_ext(lit("a/b.x/x.fa.gz"))) == "fa.gz" and value(spark, S.strip_ext(lit("x.fa.gz"))) == "x"
    assert value(spark, S.interval_sizes(F.array(*map(lit, (3, 5, 10, 17))))) == [2, 7]
    assert value(spark, P.dec_to_hexa(lit(0))) == "" and value(spark, P.dec_to_hexa(lit(255))) == "FF"
    assert value(spark, P.code(lit("ACGT"))) == 27
    assert value(spark, P.filtered_hash(lit("ACAGG"))) == 65535 and value(spark, P.filtered_hash(lit("CCCCC"))) == 341


def test_invalid_letter(spark):
    with pytest.raises(Exception, match="Invalid nucleotide"):
        value(spark, S.revcomp(F.concat(lit("AC"), F.col("id").cast("string"), lit("Z")), strict=True))


def test_inverses(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGTacgtNn") for _ in range(rng.randrange(0, 60))), "".join(rng.choice("ACGT") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 20)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, h string")
    s, h = F.col("s"), F.col("h")
    bad = df.filter((S.revcomp(S.revcomp(s)) != s) | (S.decompress(S.compress(h, 2), S.run_bed(h, 2, compressed=True)) != h) | (P.unpack_2bit(P.pack_2bit(h), F.length(h)) != h))
    assert bad.count() == 0
