"""Sequence functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

GAP_CHARS = "NnXx"
#: Bases and their complements.
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def rev(s: Column) -> Column:
    return F.reverse(s)


def complement(s: Column) -> Column:
    return F.translate(s, BASES, COMPLEMENTS)


def revcomp(s: Column, strict: bool = False) -> Column:
    """Reverse complement; N, X and * stay. strict: any other letter is an error."""
    done = F.reverse(complement(s))
    if not strict:
        return done
    return F.when(s.rlike("[^ACGTacgtNnXx*]"), F.raise_error(F.lit("Invalid nucleotide"))).otherwise(done)


def unmask(s: Column) -> Column:
    return F.upper(s)


def erase_chars(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "")


def count_of(s: Column, chars: str) -> Column:
    """How many characters of ``s`` are among ``chars``."""
    return (F.length(s) - F.length(F.translate(s, chars, ""))).cast("long")


def base_counts(s: Column) -> dict[str, Column]:
    return {b: count_of(s, b.upper() + b) for b in "acgt"}


def lower_count(s: Column) -> Column:
    return count_of(s, "abcdefghijklmnopqrstuvwxyz")


def gc_content(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Percent; null where there is no base."""
    return F.try_divide(g + c, a + c + g + t) * 100


def slice_1(s: Column, start: Column, end: Column) -> Column:
    """1-based inclusive slice; 0, 0 is the whole; a null sequence stays null."""
    return F.when((start == 0) & (end == 0), s).otherwise(F.substring(s, start.cast("int"), (end - start + 1).cast("int")))


def slice_length(length: Column, start: Column, end: Column) -> Column:
    return F.when((start == 0) & (end == 0), length).otherwise(end - start + 1)


def erase_interval(s: Column, start: Column, end: Column) -> Column:
    """Without the 0-based half-open interval."""
    return F.concat(F.substring(s, F.lit(1), start.cast("int")), F.substring(s, (end + 1).cast("int"), F.length(s)))


def runs(s: Column) -> Column:
    """Array of runs of equal characters."""
    return F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))


def compress(s: Column, cutoff: int | Column = 1) -> Column:
    """Runs longer than ``cutoff`` become one base."""
    n = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return F.array_join(F.transform(runs(s), lambda r: F.when(F.length(r) > n, F.substring(r, 1, 1)).otherwise(r)), "")


def run_bed(s: Column, cutoff: int = 1, compressed: bool = False) -> Column:
    """Array of (start, end) of runs longer than ``cutoff``, 0-based half-open.

    compressed: start is the place in the compressed sequence and end is start plus the run's length. Linear in the sequence.
    """
    return _compressed_bed(s, F.lit(cutoff)) if compressed else _plain_bed(s, F.lit(cutoff))


def _beds(texts: pd.Series, cutoffs: pd.Series, compressed: bool) -> pd.Series:
    out = []
    for text, cutoff in zip(texts, cutoffs):
        if text is None:
            out.append(None)
            continue
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.concatenate(([0], np.flatnonzero(letters[1:] != letters[:-1]) + 1, [len(letters)])) if len(letters) else np.zeros(1, np.int64)
        n = np.diff(edges)
        long = n > cutoff
        start = np.concatenate(([0], np.cumsum(np.where(long, 1, n))[:-1])) if compressed and len(n) else edges[:-1]
        out.append([{"start": a, "end": a + m} for a, m in zip(start[long].tolist(), n[long].tolist())])
    return pd.Series(out, dtype=object)


_BED = ArrayType(StructType().add("start", "long").add("end", "long"))


@F.pandas_udf(_BED)
def _plain_bed(texts: pd.Series, cutoffs: pd.Series) -> pd.Series:
    return _beds(texts, cutoffs, False)


@F.pandas_udf(_BED)
def _compressed_bed(texts: pd.Series, cutoffs: pd.Series) -> pd.Series:
    return _beds(texts, cutoffs, True)


@F.pandas_udf(StringType())
def _decompressed(texts: pd.Series, beds: pd.Series) -> pd.Series:
    out = []
    for text, bed in zip(texts, beds):
        if text is None or bed is None:
            out.append(None)
            continue
        parts, at = [], 0
        for r in bed:
            parts += [text[at : r["start"]], text[r["start"]] * (r["end"] - r["start"])]
            at = r["start"] + 1
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def decompress(s: Column, bed: Column) -> Column:
    """Inverse of ``compress``, given its (start, end) list in the compressed sequence. Linear in both."""
    return _decompressed(s, bed)


def homopolymer_runs(s: Column, threshold: int = 1) -> Column:
    """Runs of at least ``threshold + 1`` equal bases."""
    return F.size(F.filter(runs(s), lambda r: F.length(r) > threshold))


def cigar_match(cigar: Column) -> Column:
    """The leading match length; 0 where there is none."""
    return F.coalesce(F.regexp_extract(cigar, r"^([0-9]+)M", 1).try_cast("long"), F.lit(0).cast("long"))


def round2(x: Column) -> Column:
    return F.round(x, 2)


def interval_sizes(ends: Column) -> Column:
    """end - start for the array (start, end, start, end, ...)."""
    return F.transform(F.filter(ends, lambda _, i: i % 2 == 1), lambda e, i: e - F.get(ends, (2 * i).cast("int")))


def parse_coordinate(s: Column) -> Column:
    """``header:start-end`` to a struct; anything else is a header with 0, 0."""
    pattern = r"^(.*):([0-9]+)-([0-9]+)$"
    hit = s.rlike(pattern)
    part = lambda i: F.regexp_extract(s, pattern, i)
    return F.struct(
        F.when(hit, part(1)).otherwise(s).alias("header"),
        F.when(hit, part(2)).otherwise("0").cast("long").alias("start"),
        F.when(hit, part(3)).otherwise("0").cast("long").alias("end"),
    )


def is_int(s: Column) -> Column:
    return s.rlike("^[+-]?[0-9]+$")


def is_number(s: Column) -> Column:
    return s.rlike("^[0-9]*$")


def text_wrap(s: Column, width: int) -> Column:
    return F.array_join(F.regexp_extract_all(s, F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")


def file_ext(name: Column) -> Column:
    """``x.fa.gz`` gives ``fa.gz``."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"\.([^.]+(?:\.gz)?)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def strip_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+(\.gz)?$", "")
