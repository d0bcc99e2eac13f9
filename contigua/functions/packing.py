"""2-bit codes, hexadecimal and canonical k-mers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contigua.functions.seq import revcomp


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; letters sort as their 2-bit codes do."""
    return F.least(kmer, revcomp(kmer))


def code(kmer: Column) -> Column:
    """Big-endian 2-bit value of up to 31 upper-case bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def dec_to_hexa(n: Column) -> Column:
    """Upper-case hexadecimal; 0 is the empty string."""
    return F.when(n == 0, "").otherwise(F.hex(n))


def pack_2bit(s: Column) -> Column:
    """Four bases a byte, first base highest; other letters pack as A. Padded with A."""
    digits = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "A"), "ACGT", "0123")
    whole = F.rpad(digits, (F.ceil(F.length(digits) / 4) * 4).cast("int"), "0")
    octets = F.regexp_extract_all(whole, F.lit("(....)"), F.lit(1))
    return F.unhex(F.array_join(F.transform(octets, lambda q: F.lpad(F.conv(q, 4, 16), 2, "0")), ""))


def unpack_2bit(packed: Column, length: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(packed), F.lit("(..)"), F.lit(1))
    digits = F.array_join(F.transform(pairs, lambda h: F.lpad(F.conv(h, 16, 4), 4, "0")), "")
    return F.substring(F.translate(digits, "0123", "ACGT"), F.lit(1), length.cast("int"))


def masked_dna(s: Column) -> Column:
    """Upper case; everything that is not a base is N."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "N")


def filtered_hash(smer: Column) -> Column:
    """2-bit value of an s-mer, or 65535 where it begins AAA or ACA, or has AA at places 2 to 4.

    Shorter s-mers count as padded in front with A.
    """
    padded = F.lpad(smer, 5, "A") if smer is not None else smer
    tested = F.when(F.length(smer) < 5, padded).otherwise(smer)
    return F.when(tested.rlike("^(AAA|ACA)|^.{1,3}AA"), F.lit(65535)).otherwise(code(smer))
