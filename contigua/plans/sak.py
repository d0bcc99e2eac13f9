"""The edit language: tab-separated instructions, folded over an assembly as DataFrame transformations.

Parsing is on the driver (a program is a short text); each instruction maps an Assembly to a new one. Neighbouring
instructions that only rename, describe, drop or resize what they name (``BULK``) are folded by name on the driver, checked against the
tables in one job a table, and applied as one join each, however many they are. Lineage is cut every ``CUT_EVERY`` other instructions.

Names: what an instruction makes (paths of JOIN, SPLIT and RENAME, segments and the edge of CLEAVE, gaps of JOIN and EXCISE) must not
be there already, but for what the instruction itself takes away; else it is an error and nothing is changed. Gaps without a name of their own
get one that the assembly does not have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby

import re

from pyspark.sql import DataFrame, functions as F

from contigua.functions import seq as S
from contigua.model import GAP, SEGMENT, Assembly
from contigua.operators import paths as E
from contigua.operators.lineage import Rounds
from contigua.operators.stats import placed

CUT_EVERY = 20


@dataclass(frozen=True)
class Instruction:
    verb: str
    args: tuple[str, ...]

    def arg(self, i: int, default: str = "") -> str:
        return self.args[i] if i < len(self.args) and self.args[i] != "" else default


@dataclass
class State:
    assembly: Assembly
    beds: list[tuple[str, DataFrame]] = field(default_factory=list)  # last in, first out
    new_gaps: int | None = None  # the greatest number of a name given here; None: not looked up yet

    def gap_name(self, wanted: str = "") -> str:
        if wanted:
            _free(self.assembly.gaps, wanted, "gap")
            return wanted
        if self.new_gaps is None:
            number = F.regexp_extract("header", r"^gap_e([0-9]{1,17})$", 1).try_cast("long")
            self.new_gaps = self.assembly.gaps.agg(F.max(number)).first()[0] or 0
        self.new_gaps += 1
        return f"gap_e{self.new_gaps}"


def parse(text: str) -> list[Instruction]:
    out = []
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        verb, *args = line.rstrip("\r").split("\t")
        if verb.upper() not in VERBS:
            raise ValueError(f"unknown instruction: {verb}")
        out.append(Instruction(verb.upper(), tuple(a.strip() for a in args)))
    return out


def path_ref(text: str) -> tuple[str, int, int, str]:
    """``name(start:end)+`` to (name, start, end, orientation); without a slice 0, 0; without a sign +."""
    name, start, end, sign = re.fullmatch(r"(.*?)(?:\((\d+):(\d+)\))?([+-]?)", text).groups()
    return name, int(start or 0), int(end or 0), sign or "+"


def _known(table: DataFrame, name: str, what: str) -> None:
    """An instruction that names what is not there is an error."""
    if table.filter(F.col("header") == name).isEmpty():
        raise ValueError(f"no {what} named {name}")


def _free(table: DataFrame, name: str, what: str, *but: str) -> None:
    """A new name must not be taken, but by what goes (``but``)."""
    if not name:
        raise ValueError(f"a new {what} needs a name")
    if name not in but and not table.filter(F.col("header") == name).isEmpty():
        raise ValueError(f"there is a {what} named {name} already")


def _two(one: str, other: str, what: str) -> None:
    if one == other:
        raise ValueError(f"two new {what}s can't both be named {one}")


def _placed(a: Assembly, own: DataFrame) -> DataFrame:
    """Components of a path or two, ``own``, with what they stand for. They are written once, and meet only what they name; so is the result,
    which edits read several times."""
    store = Rounds(own.sparkSession, keep=1 << 30)
    own = store.write(own)
    names = own.select(F.col("comp").alias("header")).distinct()
    return store.write(placed(own, a.segments.join(names, "header", "left_semi"), a.gaps.join(names, "header", "left_semi")))


def _add_gap(a: Assembly, name: str, s1: str, o1: str, s2: str, o2: str, dist: int) -> DataFrame:
    row = a.gaps.sparkSession.createDataFrame([(name, s1, o1, s2, o2, dist)], "header string, s1 string, s1_or string, s2 string, s2_or string, dist long")
    tag = F.array(F.struct(F.lit("SC").alias("label"), F.lit("i").alias("type"), F.lit("1").alias("content")))
    return a.gaps.unionByName(row.withColumn("tags", tag), allowMissingColumns=True)


def _end(components: DataFrame, last: bool) -> tuple[str, str]:
    """The outermost segment of one path: a single row, by minimum or maximum."""
    key = F.max_by if last else F.min_by
    r = components.filter(F.col("ctype") == SEGMENT).agg(key("comp", "ord").alias("c"), key("orientation", "ord").alias("o")).first()
    return r.c or "", r.o or "+"


def _without(a: Assembly, *names: str) -> Assembly:
    return a.with_(components=a.components.filter(~F.col("path").isin(*names)), paths=a.paths.filter(~F.col("header").isin(*names)))


def _part(a: Assembly, ref: tuple[str, int, int, str]) -> DataFrame:
    name, start, end, sign = ref
    own = a.components.filter(F.col("path") == name)
    if start or end:
        own = E.trim(_placed(a, own), F.lit(start), F.lit(end)).select(*E.KEYS)
    return E.revcom(own) if sign == "-" else own


def join(st: State, i: Instruction) -> State:
    a = st.assembly
    one, two, new = path_ref(i.arg(0)), path_ref(i.arg(1)), i.arg(4)
    for name in (one[0], two[0]):
        _known(a.paths, name, "path")
    gone = [r[0] for r in (one, two) if not (r[1] or r[2])]  # of sliced ones the rest stays
    _free(a.paths, new, "path", *gone)
    first, second = _part(a, one), _part(a, two)
    name = st.gap_name(i.arg(3))
    (c1, o1), (c2, o2) = _end(first, True), _end(second, False)
    left = _without(a, *gone) if gone else a
    comps = E.join_paths(left.components, first, second, name, new)
    row = a.paths.sparkSession.createDataFrame([(new,)], "header string")
    return State(left.with_(components=comps, gaps=_add_gap(a, name, c1, o1, c2, o2, int(i.arg(2, "0"))), paths=left.paths.unionByName(row, allowMissingColumns=True)), st.beds, st.new_gaps)


def split(st: State, i: Instruction) -> State:
    a, (c1, c2, new1, new2) = st.assembly, (i.arg(k) for k in range(4))
    gap = a.gaps.filter(((F.col("s1") == c1) & (F.col("s2") == c2)) | ((F.col("s1") == c2) & (F.col("s2") == c1))).agg(F.min("header").alias("h")).first().h
    if gap is None:
        raise ValueError(f"no gap between {c1} and {c2}")
    at = a.components.filter((F.col("ctype") == GAP) & (F.col("comp") == gap)).agg(F.min(F.struct(F.col("path").alias("p"), F.col("ord").alias("o"))).alias("at")).first().at
    if at is None:
        raise ValueError(f"no path holds the gap between {c1} and {c2}")
    _two(new1, new2, "path")
    for name in (new1, new2):
        _free(a.paths, name, "path", at.p)
    comps = E.split_at(a.components, F.col("path") == at.p, F.lit(at.o), new1, new2)
    rows = a.paths.sparkSession.createDataFrame([(new1,), (new2,)], "header string")
    kept = a.paths.filter(F.col("header") != at.p).unionByName(rows, allowMissingColumns=True)
    return State(a.with_(components=comps, paths=kept, gaps=a.gaps.filter(F.col("header") != gap)), st.beds, st.new_gaps)


def excise(st: State, i: Instruction) -> State:
    a, contig = st.assembly, i.arg(0)
    _known(a.segments, contig, "segment")
    name = st.gap_name(i.arg(2))
    comps = E.excise(a.components, F.col("comp") == contig, F.lit(name))
    incident = (F.col("s1") == contig) | (F.col("s2") == contig)
    sides = a.gaps.filter(incident & (F.col("s1") != F.col("s2"))).agg(F.max(F.when(F.col("s2") == contig, F.struct("s1", "s1_or"))).alias("l"), F.max(F.when(F.col("s1") == contig, F.struct("s2", "s2_or"))).alias("r")).first()
    left, right = (sides.l.s1, sides.l.s1_or) if sides.l else ("", "+"), (sides.r.s2, sides.r.s2_or) if sides.r else ("", "+")
    without = a.with_(gaps=a.gaps.filter(~incident))
    return State(a.with_(components=comps, gaps=_add_gap(without, name, *left, *right, int(i.arg(1, "0")))), st.beds, st.new_gaps)


def remove(st: State, i: Instruction) -> State:
    a, contig = st.assembly, i.arg(0)
    _known(a.segments, contig, "segment")
    using = a.components.filter((F.col("comp") == contig) & (F.col("ctype") == SEGMENT)).select("path").distinct()
    paths = a.paths.join(using, F.col("header") == F.col("path"), "left_anti")
    incident = (F.col("s1") == contig) | (F.col("s2") == contig)
    out = a.with_(components=a.components.join(using, "path", "left_anti").select(*a.components.columns), paths=paths, segments=a.segments.filter(F.col("header") != contig), edges=a.edges.filter(~incident), gaps=a.gaps.filter(~incident))
    return State(out, st.beds, st.new_gaps)


def _rewrite(st: State, contig: str, make: Callable, quality: Callable | None = None) -> State:
    a = st.assembly
    _known(a.segments, contig, "segment")
    hit = F.col("header") == contig
    segs = a.segments.withColumn("sequence", F.when(hit, make(F.col("sequence"))).otherwise(F.col("sequence")))
    if quality is not None and "quality" in a.segments.columns:
        segs = segs.withColumn("quality", F.when(hit, quality(F.col("quality"))).otherwise(F.col("quality")))
    return State(a.with_(segments=segs), st.beds, st.new_gaps)


def erase(st: State, i: Instruction) -> State:
    name, _, span = i.arg(0).rpartition(":")
    start, _, end = span.partition("-")
    cut = lambda s: S.erase_interval(s, F.lit(int(start)), F.lit(int(end)))
    return _rewrite(st, name, cut, cut)


def rvcp(st: State, i: Instruction) -> State:
    a, name = st.assembly, i.arg(0)
    if not a.segments.filter(F.col("header") == name).isEmpty():
        return _rewrite(st, name, lambda s: S.revcomp(s, strict=True), S.rev)
    _known(a.paths, name, "segment or path")
    return State(a.with_(components=E.revcom(a.components, F.col("path") == name)), st.beds, st.new_gaps)


def invert(st: State, i: Instruction) -> State:
    return _rewrite(st, i.arg(0), S.rev, S.rev)


def compress(st: State, i: Instruction) -> State:
    name, cutoff = i.arg(0), int(i.arg(1, "1"))
    bed = st.assembly.segments.filter(F.col("header") == name).select(F.col("header").alias("__h"), S.run_bed(F.col("sequence"), cutoff, compressed=True).alias("__bed")).checkpoint()
    out = _rewrite(st, name, lambda s: S.compress(s, cutoff))
    return State(out.assembly, [*st.beds, (name, bed)], st.new_gaps)


def decompress(st: State, i: Instruction) -> State:
    if not st.beds:
        raise ValueError("nothing to decompress")
    _, bed = st.beds[-1]
    a, name = st.assembly, i.arg(0)
    _known(a.segments, name, "segment")
    with_bed = a.segments.join(bed.withColumn("__h", F.lit(name)), F.col("header") == F.col("__h"), "left")
    segs = with_bed.withColumn("sequence", F.when(F.col("__bed").isNull(), F.col("sequence")).otherwise(S.decompress(F.col("sequence"), F.coalesce("__bed", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))))
    return State(a.with_(segments=segs.select(*a.segments.columns)), st.beds[:-1], st.new_gaps)


def mask(st: State, i: Instruction) -> State:
    a, path, lo, hi = st.assembly, i.arg(0), int(i.arg(1)), int(i.arg(2))
    _known(a.paths, path, "path")
    name, size = st.gap_name(), int(i.arg(3, str(hi - lo)))
    mine = F.col("path") == path
    own = E.mask(_placed(a, a.components.filter(mine)), F.lit(lo), F.lit(hi), F.lit(name), F.lit(size).cast("long"))
    comps = a.components.filter(~mine).select(*E.KEYS).unionByName(own.select(*E.KEYS))
    at = own.filter(F.col("comp") == name).select(F.col("ord").alias("at"))
    sides = own.crossJoin(F.broadcast(at)).filter(F.col("ctype") == SEGMENT).agg(F.max_by(F.struct("comp", "orientation"), F.when(F.expr("ord < at"), F.col("ord"))).alias("l"), F.min_by(F.struct("comp", "orientation"), F.when(F.expr("ord > at"), F.col("ord"))).alias("r")).first()  # one row beside a path
    left = tuple(sides.l) if sides.l else ("", "+")
    right = tuple(sides.r) if sides.r else ("", "+")
    return State(a.with_(components=comps, gaps=_add_gap(a, name, *left, *right, size)), st.beds, st.new_gaps)


def cleave(st: State, i: Instruction) -> State:
    a, (contig, pos, left, right) = st.assembly, (i.arg(k) for k in range(4))
    _known(a.segments, contig, "segment")
    _two(left, right, "segment")
    for name in (left, right):
        _free(a.segments, name, "segment", contig)
    if i.arg(4):
        _free(a.edges, i.arg(4), "edge")
    n, hit = int(pos), F.col("header") == contig
    two = F.when(hit, F.array(F.struct(F.lit(left).alias("h"), F.substring("sequence", 1, n).alias("s")), F.struct(F.lit(right).alias("h"), F.expr(f"substring(sequence, {n + 1}, length(sequence))").alias("s")))).otherwise(F.array(F.struct(F.col("header").alias("h"), F.col("sequence").alias("s"))))
    segs = a.segments.withColumn("__two", F.explode(two)).withColumn("header", F.col("__two.h")).withColumn("sequence", F.col("__two.s")).drop("__two")
    comps = E.cleave_components(a.components, (F.col("comp") == contig) & (F.col("ctype") == SEGMENT), F.lit(left), F.lit(right))
    edges = E.cleave_edges(a.edges, contig, left, right, i.arg(4) or None)
    gaps = E.cleave_edges(a.gaps, contig, left, right)
    return State(a.with_(segments=segs, components=comps, edges=edges, gaps=gaps), st.beds, st.new_gaps)


# -- instructions that touch only what they name ------------------------------------------------------


@dataclass
class _Names:
    """Names of one table through a program: what each is called now, and which must be there or free to begin with."""

    what: str
    now: dict[str, str] = field(default_factory=dict)  # called now -> called first, of those touched
    gone: set[str] = field(default_factory=set)
    needed: dict[str, None] = field(default_factory=dict)
    absent: dict[str, None] = field(default_factory=dict)

    def first(self, name: str) -> str:
        if name in self.gone:
            raise ValueError(f"no {self.what} named {name}")
        if name not in self.now:
            self.needed[name] = None
            self.now[name] = name
        return self.now[name]

    def drop(self, name: str) -> str:
        own = self.first(name)
        del self.now[name]
        self.gone.add(name)
        return own

    def rename(self, old: str, new: str) -> str:
        own = self.first(old)
        if new == old:
            return own
        if not new:
            raise ValueError(f"a new {self.what} needs a name")
        if new in self.now:
            raise ValueError(f"there is a {self.what} named {new} already")
        if new not in self.gone:
            self.absent[new] = None
        self.drop(old)
        self.gone.discard(new)
        self.now[new] = own
        return own

    def check(self, table: DataFrame) -> None:
        if not (self.needed or self.absent):
            return
        asked = _listed(table, [(n,) for n in {**self.needed, **self.absent}], "header string")
        there = {r.header for r in table.join(asked, "header", "left_semi").select("header").distinct().collect()}  # of the program's names
        for name in self.needed:
            if name not in there:
                raise ValueError(f"no {self.what} named {name}")
        for name in self.absent:
            if name in there:
                raise ValueError(f"there is a {self.what} named {name} already")


def _listed(table: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The program's rows; sent to all tasks if there are at most 100,000."""
    own = table.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(own) if len(rows) <= 100_000 else own


def _bulk(st: State, program: list[Instruction]) -> State:
    """RENAME, COMMENT, EXCLUDE and RESIZE, as if one by one."""
    a, paths, gaps = st.assembly, _Names("path"), _Names("gap")
    called: dict[str, str | None] = {}
    comments: dict[str, str] = {}
    sizes: dict[str, int] = {}
    for i in program:
        if i.verb == "RESIZE":
            sizes[gaps.first(i.arg(0))] = int(i.arg(1))
        elif i.verb == "EXCLUDE":
            called[paths.drop(i.arg(0))] = None
        elif i.verb == "COMMENT":
            comments[paths.first(i.arg(0))] = i.arg(1)
        else:
            called[paths.rename(i.arg(0), i.arg(1))] = i.arg(1)
    paths.check(a.paths)
    gaps.check(a.gaps)
    if sizes:
        new = _listed(a.gaps, list(sizes.items()), "__h string, __dist long")
        rows = a.gaps.join(new, F.col("header") == F.col("__h"), "left").withColumn("dist", F.coalesce("__dist", "dist"))
        a = a.with_(gaps=rows.select(*a.gaps.columns))
    if called:
        new = _listed(a.paths, [(k, v, v is None) for k, v in called.items()], "__h string, __new string, __gone boolean")

        def moved(table: DataFrame, column: str) -> DataFrame:
            rows = table.join(new, F.col(column) == F.col("__h"), "left").filter(~F.coalesce("__gone", F.lit(False)))
            return rows.withColumn(column, F.coalesce("__new", column)).select(*table.columns)

        if comments:
            a = a.with_(paths=_commented(a.paths, comments))
        return State(a.with_(paths=moved(a.paths, "header"), components=moved(a.components, "path")), st.beds, st.new_gaps)
    return State(a.with_(paths=_commented(a.paths, comments)) if comments else a, st.beds, st.new_gaps)


def _commented(paths: DataFrame, comments: dict[str, str]) -> DataFrame:
    new = _listed(paths, list(comments.items()), "__h string, __comment string")
    rows = paths.join(new, F.col("header") == F.col("__h"), "left").withColumn("comment", F.coalesce("__comment", "comment"))
    return rows.select(*paths.columns)


BULK = ("RENAME", "COMMENT", "EXCLUDE", "RESIZE")


def _alone(st: State, i: Instruction) -> State:
    return _bulk(st, [i])


VERBS: dict[str, Callable[[State, Instruction], State]] = {
    "JOIN": join, "SPLIT": split, "EXCISE": excise, "REMOVE": remove, "ERASE": erase, "RVCP": rvcp, "INVERT": invert, "COMPRESS": compress,
    "DECOMPRESS": decompress, "EXCLUDE": _alone, "RESIZE": _alone, "MASK": mask, "CLEAVE": cleave, "RENAME": _alone, "COMMENT": _alone,
}


def run(assembly: Assembly, program: str | list[Instruction]) -> Assembly:
    state, since = State(assembly), 0
    for bulk, own in groupby(parse(program) if isinstance(program, str) else program, key=lambda i: i.verb in BULK):
        if bulk:
            state = _bulk(state, list(own))
            continue
        for i in own:
            state, since = VERBS[i.verb](state, i), since + 1
            if since % CUT_EVERY == 0:
                state.assembly = state.assembly.cut()
    return state.assembly
