"""Schemas and the assembly as a bundle of DataFrames.

Records are keyed by header. Slices of path components are 1-based and inclusive, with 0, 0 for the
whole; BED intervals are 0-based and half-open. A gap or edge in a path has the orientation '0'.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

TAGS = "array<struct<label:string,type:string,content:string>>"
SEGMENTS = f"header string, comment string, seq_pos long, sequence string, quality string, ln_length long, tags {TAGS}"
GAPS = f"header string, s1 string, s1_or string, s2 string, s2_or string, dist long, tags {TAGS}"
EDGES = f"header string, s1 string, s1_or string, s2 string, s2_or string, cigar string, tags {TAGS}"
PATHS = "header string, comment string, seq_pos long"
COMPONENTS = "path string, ord long, ctype string, comp string, orientation string, start long, end long"
READS = "header string, comment string, sequence string, quality string, seq_pos long"
BED = "chrom string, start long, end long, ord long"
AGP = "object string, obj_start long, obj_end long, part long, ctype string, c6 string, c7 string, c8 string, c9 string, line_no long"
VARIANTS = "segment string, grp long, alt long, vtype string, ref_len int, pos long, sequence string, score double"

SEGMENT, GAP, EDGE = "SEGMENT", "GAP", "EDGE"


@dataclass(frozen=True)
class Assembly:
    """Five tables. Every edit returns a new one; nothing is changed in place."""

    segments: DataFrame
    gaps: DataFrame
    edges: DataFrame
    paths: DataFrame
    components: DataFrame

    def with_(self, **tables: DataFrame) -> "Assembly":
        return replace(self, **tables)

    def cut(self) -> "Assembly":
        """Checkpoints every table, for long edit programs."""
        return Assembly(*(getattr(self, f).checkpoint() for f in ("segments", "gaps", "edges", "paths", "components")))
