"""Records split at runs of N or X into alternating segments and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from contigua.functions import seq as S
from contigua.model import GAP, SEGMENT

FEATURE = r"([NnXx]+|[^NnXx]+)"


def features(records: DataFrame, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """(header, i, name, kind, text, len, last, n): a row a run; i counts from 1 over segments and gaps alike, ``last`` tells a record's last run,
    ``n`` how many it has."""
    runs = F.regexp_extract_all(F.col(sequence), F.lit(FEATURE), F.lit(1))
    own = records.select(F.col(header).cast("string").alias("header"), runs.alias("runs")).withColumn("n", F.size("runs"))
    # outer, as a filter on the array's size would find the runs a second time
    rows = own.select("header", "n", F.posexplode_outer("runs").alias("p", "text")).filter("p IS NOT NULL")
    return rows.select(
        "header",
        (F.col("p") + 1).cast("long").alias("i"),
        F.concat_ws(".", "header", (F.col("p") + 1).cast("string")).alias("name"),
        F.when(F.left("text", F.lit(1)).isin(*"NnXx"), GAP).otherwise(SEGMENT).alias("kind"),
        "text",
        F.length("text").cast("long").alias("len"),
        (F.col("p") + 1 == F.col("n")).alias("last"),
        F.col("n").cast("long").alias("n"),
    )


def segments_of(feats: DataFrame) -> DataFrame:
    return feats.filter(F.col("kind") == SEGMENT).select("header", "i", "name", "text", "len", *(c.alias(b) for b, c in S.base_counts(F.col("text")).items()), S.lower_count(F.col("text")).alias("lower"))


def gaps_of(feats: DataFrame) -> DataFrame:
    """Gaps between their neighbours. A leading gap is one of the first segment with itself (+, +), a
    trailing one of the last (+, -); a record that is all gap has no segment to name. Runs alternate and are named by their
    number, so neighbours are known without meeting them."""
    at = lambda i: F.concat_ws(".", "header", i.cast("string"))
    prev, next_ = F.when(F.col("i") > 1, at(F.col("i") - 1)), F.when(~F.col("last"), at(F.col("i") + 1))
    sides = feats.filter(F.col("kind") == GAP).withColumn("prev", prev).withColumn("next", next_)
    return sides.select(
        "header", "i", "name",
        F.coalesce("prev", "next").alias("s1"), F.lit("+").alias("s1_or"),
        F.coalesce("next", "prev").alias("s2"), F.when(F.col("next").isNull() & F.col("prev").isNotNull(), "-").otherwise("+").alias("s2_or"),
        F.col("len").alias("dist"),
    )


def components_of(feats: DataFrame, *more: str) -> DataFrame:
    """Each record as a path over its features; ``more``: columns of these that are kept."""
    return feats.select(
        F.col("header").alias("path"), F.col("i").alias("ord"), F.col("kind").alias("ctype"), F.col("name").alias("comp"),
        F.when(F.col("kind") == GAP, "0").otherwise("+").alias("orientation"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), *more,
    )


def terminal_gaps() -> tuple[Column, Column]:
    """Of components with ``last``: whether one is a gap of a segment with itself, and how many such stand before it in its record. Only a
    first and a last run can be, and a record that is all gap has no segment; runs alternate, so any row tells what the first is."""
    gap, first = F.col("ctype") == GAP, F.col("ord") == 1
    return gap & (first != F.col("last")), F.when(~first & (gap == (F.col("ord") % 2 == 1)), 1).otherwise(0).cast("long")


def soft_masked(sequence: Column, compat: bool = False) -> Column:
    """Lower-case characters outside gaps. compat: as the sum of per-segment counts that charge the first
    n or x of a gap to the segment before it, and the others to that after it."""
    plain = S.lower_count(F.translate(sequence, "nx", ""))
    if not compat:
        return plain
    body = F.regexp_replace(sequence, "([^NnXx][NnXx])[NnXx]*$", "$1")  # what trails behind the last segment's first is lost
    return F.when(sequence.rlike("[^NnXx]"), S.lower_count(body)).otherwise(0).cast("long")


def homopolymer_bed(records: DataFrame, cutoff: int = 1, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """(header, start, end) of runs of more than ``cutoff`` equal letters, 0-based half-open; a record's runs are found where it
    lies, by comparing it with itself one letter on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*batch.columns):
                letters = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)
                edges = np.concatenate(([0], np.flatnonzero(letters[1:] != letters[:-1]) + 1, [len(letters)])) if len(letters) else np.zeros(1, np.int64)
                long = np.flatnonzero(np.diff(edges) > cutoff)
                if len(long):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(long), name.type), pa.array(edges[long]), pa.array(edges[long + 1])], names=["header", "start", "end"])

    own = records.select(F.col(header).alias("header"), F.col(sequence).alias("sequence"))
    return own.mapInArrow(run, StructType(own.schema.fields[:1]).add("start", "long").add("end", "long"))


def homopolymer_compressed(records: DataFrame, cutoff: int, sequence: str = "sequence") -> DataFrame:
    """Records with runs of more than ``cutoff`` equal letters as one, as they may be ingested; 0 changes nothing. Lengths are then those
    of the compressed sequence."""
    return records.withColumn(sequence, S.compress(F.col(sequence), cutoff)) if cutoff else records
