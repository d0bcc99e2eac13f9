"""Readers, writers, the edit language and streaming, on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from contigua.model import Assembly
from contigua.operators import stats
from contigua.plans import sak
from contigua.sources import readers, sinks
from contigua.streaming import reads as streaming

GFA1 = "H\tVN:Z:1.2\nS\ta\tACGTA\tXX:i:3\nS\tb\tGG\nS\tc\t*\tLN:i:7\nL\ta\t+\tb\t+\t1M\nJ\tb\t+\tc\t-\t12\nP\tp1\ta+,b(1:1)+;c-\t*\tC:Z:note\n"
GFA2 = "H\tVN:Z:2.0\nS\ta\t5\tACGTA\nS\tb\t2\tGG\nS\tc\t7\t*\nE\te1\ta+\tb+\t4\t5$\t0\t1\t1M\nG\tg1\tb+\tc-\t12\t*\nO\tp1\ta+ e1 b+ g1 c-\tC:Z:note\n"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def write(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name", ["x.fa", "x.fa.gz"])
def test_fasta(spark, tmp_path, name):
    path = write(tmp_path, name, ">h1 a note > here\nACG\nTNN\nAC\n>h2\nTT\n>h3\n")
    assert readers.sniff(spark, path) == "fasta"
    assert rows(readers.read_fasta(spark, path), "header", "comment", "sequence") == [("h1", "a note > here", "ACGTNNAC"), ("h2", "", "TT"), ("h3", "", "")]
    a = readers.read_assembly(spark, path)
    out = sinks.path_sequences(stats.placed(a.components, a.segments, a.gaps))
    assert rows(out, "path", "seq") == [("h1", "ACGTNNAC"), ("h2", "TT")]
    assert rows(readers.is_gzip(spark, path), "gzip") == [(name.endswith(".gz"),)]


def test_fastq(spark, tmp_path):
    path = write(tmp_path, "x.fq", "@r1 c\nACGT\n+\nII@I\n@r2\nGG\n+r2\n@!\n")
    got = readers.read_fastq(spark, path)
    assert rows(got, "header", "comment", "sequence", "quality") == [("r1", "c", "ACGT", "II@I"), ("r2", "", "GG", "@!")]
    again = write(tmp_path, "y.fq", "\n".join(r.line for r in sinks.fastq_lines(got).collect()) + "\n")
    assert rows(readers.read_fastq(spark, again), "header", "quality") == rows(got, "header", "quality")
    with pytest.raises(Exception, match="ends inside"):
        readers.read_fastq(spark, write(tmp_path, "z.fq", "@r\nAC\n+\n")).collect()


@pytest.mark.parametrize("text", [GFA1, GFA2])
def test_gfa(spark, tmp_path, text):
    a = readers.read_assembly(spark, write(tmp_path, "x.gfa", text))
    assert rows(a.segments, "header", "sequence", "ln_length")[-1][:2] == ("c", None) and a.segments.filter("header = 'c'").first().ln_length == 7
    assert rows(a.edges, "s1", "s1_or", "s2", "s2_or", "cigar") == [("a", "+", "b", "+", "1M")]
    assert rows(a.gaps, "s1", "s2", "s2_or", "dist") == [("b", "c", "-", 12)]
    assert [r[1:4] for r in rows(a.components, "ord", "ctype", "comp", "orientation")] == [("SEGMENT", "a", "+"), ("EDGE", a.edges.first().header, "0"), ("SEGMENT", "b", "+"), ("GAP", a.gaps.first().header, "0"), ("SEGMENT", "c", "-")]
    assert a.paths.first().comment == "note"
    make = sinks.gfa1_lines if text is GFA1 else sinks.gfa2_lines
    again = write(tmp_path, "y.gfa", "\n".join(r.line for r in make(a).orderBy("kind").collect()) + "\n")
    b = readers.read_gfa(spark, again)
    for t in ("segments", "gaps", "edges", "components"):
        cols = [c for c in getattr(a, t).columns if c not in ("seq_pos", "tags", "comment", "ln_length")]
        assert rows(getattr(a, t), *cols) == rows(getattr(b, t), *cols), t


def test_agp(spark, tmp_path):
    comps = spark.createDataFrame([("s1", 1, "SEGMENT", "x", "+", 0, 0, 10), ("s2", 1, "SEGMENT", "y", "+", 0, 0, 6), ("s2", 2, "GAP", "g", "0", 0, 0, 2), ("s2", 3, "SEGMENT", "z", "-", 0, 0, 4)], "path string, ord long, ctype string, comp string, orientation string, start long, end long, len long")
    path = write(tmp_path, "x.agp", "# c\nobj\t1\t5\t1\tW\ts1\t3\t7\t+\nobj\t6\t14\t2\tN\t9\tscaffold\tyes\nobj\t15\t26\t3\tW\ts2\t1\t12\t-\nobj\t27\t28\t4\tN\t2\tscaffold\tyes\nobj2\t1\t3\t1\tW\tnone\t1\t3\t+\n")
    got, missing = readers.apply_agp(comps, readers.read_agp(spark, path))
    assert rows(got, "ord", "comp", "orientation", "start", "end", "len") == [(1, "x", "+", 3, 7, 5), (2, got.filter("ord = 2").first().comp, "0", 0, 0, 9), (3, "z", "+", 0, 0, 4), (4, "g", "0", 0, 0, 2), (5, "y", "-", 0, 0, 6)]
    assert rows(missing) == [("obj2", "none")]
    lines = [r.line for r in sinks.agp_lines(stats.offsets(got)).orderBy("path", "ord").collect()]
    assert lines[0] == "obj\t1\t5\t1\tW\tx\t3\t7\t+" and lines[-1] == "obj\t21\t26\t5\tW\ty\t1\t6\t-"


def test_bed(spark, tmp_path):
    assert rows(readers.read_bed(spark, write(tmp_path, "x.bed", "a\t1\t5\nb\n")), "chrom", "start", "end") == [("a", 1, 5), ("b", 0, 0)]


def _assembly(spark) -> Assembly:
    rec = spark.createDataFrame([("s", "", "AACCCNNGTTANNNNCG", 0), ("t", "", "ACGTACGT", 1)], "header string, comment string, sequence string, seq_pos long")
    return readers.split_assembly(rec)


def _seqs(a):
    return dict(rows(sinks.path_sequences(stats.placed(a.components, a.segments, a.gaps)), "path", "seq"))


CASES = {
    "JOIN\ts+\tt-\t3\tg\tj": {"j": "AACCCNNGTTANNNNCGNNNACGTACGT"},
    "JOIN\ts(1:4)+\tt+\t1\tg\tj": {"j": "AACCNACGTACGT", "s": "AACCCNNGTTANNNNCG"},
    "SPLIT\ts.1\ts.3\tl\tr": {"l": "AACCC", "r": "GTTANNNNCG", "t": "ACGTACGT"},
    "EXCISE\ts.3\t1\tg": {"s": "AACCCNCG", "t": "ACGTACGT"},
    "REMOVE\tt.1": {"s": "AACCCNNGTTANNNNCG"},
    "ERASE\tt.1:1-3": {"s": "AACCCNNGTTANNNNCG", "t": "ATACGT"},
    "RVCP\ts.3": {"s": "AACCCNNTAACNNNNCG", "t": "ACGTACGT"},
    "RVCP\ts": {"s": "CGNNNNTAACNNGGGTT", "t": "ACGTACGT"},
    "INVERT\ts.3": {"s": "AACCCNNATTGNNNNCG", "t": "ACGTACGT"},
    "COMPRESS\ts.1\t1": {"s": "ACNNGTTANNNNCG", "t": "ACGTACGT"},
    "COMPRESS\ts.1\t1\nDECOMPRESS\ts.1": {"s": "AACCCNNGTTANNNNCG", "t": "ACGTACGT"},
    "EXCLUDE\ts": {"t": "ACGTACGT"},
    "RESIZE\ts.2\t5": {"s": "AACCCNNNNNGTTANNNNCG", "t": "ACGTACGT"},
    "MASK\tt\t2\t5": {"s": "AACCCNNGTTANNNNCG", "t": "ACNNNCGT"},
    "mask\tt\t2\t5\t1": {"s": "AACCCNNGTTANNNNCG", "t": "ACNCGT"},
    "CLEAVE\tt.1\t3\tx\ty\te": {"s": "AACCCNNGTTANNNNCG", "t": "ACGTACGT"},
    "RENAME\tt\tu": {"s": "AACCCNNGTTANNNNCG", "u": "ACGTACGT"},
}


@pytest.mark.parametrize("program", CASES)
def test_edit_language(spark, program):
    assert _seqs(sak.run(_assembly(spark), program)) == CASES[program]


TAKEN = [
    "JOIN\ts+\tt-\t3\ts.2\tj",  # a gap of that name is there
    "JOIN\ts(1:4)+\tt+\t1\tg\ts",  # the rest of s stays
    "JOIN\ts+\tt-\t3\tg\t",
    "SPLIT\ts.1\ts.3\tl\tt",
    "SPLIT\ts.1\ts.3\tl\tl",
    "EXCISE\ts.3\t1\ts.4",
    "CLEAVE\tt.1\t3\ts.1\ty",
    "CLEAVE\tt.1\t3\tx\tx",
    "RENAME\ts\tt",
    "RENAME\ts\tx\nRENAME\tt\tx",
    "RENAME\ts\tx\nCOMMENT\ts\tgone",
    "EXCLUDE\ts\nEXCLUDE\ts",
    "MASK\tt\t2\t5\nJOIN\ts+\tt-\t3\tgap_e1\tj",
]


@pytest.mark.parametrize("program", TAKEN)
def test_names_that_are_taken(spark, program):
    with pytest.raises(ValueError):
        sak.run(_assembly(spark), program)


def test_names_that_become_free(spark):
    a = _assembly(spark)
    assert set(_seqs(sak.run(a, "JOIN\ts+\tt-\t3\tg\ts"))) == {"s"}
    assert set(_seqs(sak.run(a, "SPLIT\ts.1\ts.3\ts\tr"))) == {"s", "r", "t"}
    assert _seqs(sak.run(a, "RENAME\ts\tx\nRENAME\tt\ts\nRENAME\tx\tt")) == {"t": "AACCCNNGTTANNNNCG", "s": "ACGTACGT"}
    assert _seqs(sak.run(a, "EXCLUDE\tt\nRENAME\ts\tt")) == {"t": "AACCCNNGTTANNNNCG"}
    b = sak.run(a, "CLEAVE\tt.1\t3\tt.1\ty")
    assert _seqs(b) == _seqs(a) and b.segments.filter("header = 't.1'").count() == 1


def test_two_programs_in_a_row(spark):
    """The second program's gaps have names of their own, so lengths stay."""
    a = sak.run(sak.run(_assembly(spark), "MASK\tt\t2\t5"), "MASK\ts\t0\t2\nMASK\ts\t3\t4")
    assert a.gaps.groupBy("header").count().filter("count > 1").count() == 0
    assert _seqs(a) == {"t": "ACNNNCGT", "s": "NNCNCNNGTTANNNNCG"}


def test_many_instructions_at_once(spark):
    """Thousands of lines take as many jobs as one, and do what one by one would."""
    n = 3000
    paths = spark.createDataFrame([(f"p{i}", "", i) for i in range(n)], "header string, comment string, seq_pos long")
    comps = paths.selectExpr("header AS path", "1L AS ord", "'SEGMENT' AS ctype", "'s' AS comp", "'+' AS orientation", "0L AS start", "0L AS end")
    gaps = spark.range(n).selectExpr("concat('g', id) AS header", "'s' AS s1", "'+' AS s1_or", "'s' AS s2", "'+' AS s2_or", "1L AS dist")
    a = _assembly(spark).with_(paths=paths, components=comps, gaps=gaps)
    lines = [line for i in range(n) for line in (f"RENAME\tp{i}\tq{i}", f"COMMENT\tq{i}\tc{i}", f"RESIZE\tg{i}\t{i}")] + [f"EXCLUDE\tq{i}" for i in range(0, n, 3)] + ["RESIZE\tg5\t7", "COMMENT\tq1\tlast"]
    b = sak.run(a, "\n".join(lines))
    want = {(f"q{i}", "last" if i == 1 else f"c{i}") for i in range(n) if i % 3}
    assert {tuple(r) for r in b.paths.select("header", "comment").collect()} == want and {r.path for r in b.components.collect()} == {q for q, _ in want}
    assert {r.header: r.dist for r in b.gaps.collect()} == {f"g{i}": 7 if i == 5 else i for i in range(n)}


def test_unknown_verb():
    with pytest.raises(ValueError, match="unknown instruction"):
        sak.parse("FROB\tx")


def test_vcf(spark):
    a = _assembly(spark)
    off = stats.offsets(stats.placed(a.components, a.segments, a.gaps))
    v = spark.createDataFrame([("s.3", 0, 0, "SNV", 1, 1, "C", 2.0), ("s.3", 1, 0, "DEL", 1, 2, "", 1.0), ("s.3", 1, 1, "INS", 0, 2, "G", 3.0)], "segment string, grp long, alt long, vtype string, ref_len int, pos long, sequence string, score double")
    lines = [r.line.split("\t")[:6] for r in sinks.vcf_lines(off, v).orderBy("pos").collect()]
    assert lines == [["s", "9", ".", "T", "C", "2.00"], ["s", "9", ".", "TT", "T,TGT", "2.00"]]


def test_streaming_counts(spark, tmp_path):
    reads = spark.createDataFrame([("ACGTA",), ("ACGTA",), ("GGG",)], "sequence string").repartition(3)
    reads.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), "sequence string", 1)
    streaming.count_to_db(stream, 3, str(tmp_path / "db"), str(tmp_path / "cp")).awaitTermination()
    assert rows(streaming.merged_db(spark, str(tmp_path / "db"))) == [("ACG", 4), ("CCC", 1), ("GTA", 2)]


def test_lines_to_files(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("b", 2), ("a", 1)], "line string, n int"), str(tmp_path / "o"), order=("n",), gzip=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]


def test_lists_flags_gaps_and_formats(spark, tmp_path):
    from pyspark.sql import functions as F

    from contigua.operators import filters, graph, paths, stats
    from contigua.sources import readers, sinks

    text = "H\tVN:Z:1.2\nS\ta\tACGTacgt\tCM:Z:hi\nS\tb\tGGGG\nS\tc\tTTTT\nL\ta\t+\ta\t+\t0M\nL\ta\t+\tb\t+\t2M\nJ\tb\t+\tc\t+\t5\nP\tp\ta+,b+;c-\t*\nP\tq\tb+\t*\n"
    (tmp_path / "x.gfa").write_text(text)
    a = readers.read_assembly(spark, str(tmp_path / "x.gfa"))
    bed = spark.createDataFrame([("a", 0, 4)], "chrom string, start long, end long")
    names = lambda df, c="header": sorted(r[0] for r in df.select(c).distinct().collect())
    only = filters.filter_assembly(a, included=bed)
    assert [tuple(r) for r in only.segments.select("header", "sequence").collect()] == [("a", "ACGT")] and names(only.paths) == []
    but = filters.filter_assembly(a, excluded=spark.createDataFrame([("c", 0, 0)], "chrom string, start long, end long"))
    assert names(but.segments) == ["a", "b"] and names(but.paths) == ["q"] and but.gaps.count() == 0 and but.edges.count() == 2
    assert names(filters.live(filters.flag_deleted(a.segments, "b"))) == ["a", "c"]
    comps, gaps = paths.remove_gaps(a.components, a.gaps, "c", "b")
    assert gaps.count() == 0 and comps.filter("ctype = 'GAP'").count() == 0
    rows = stats.segment_table(a.segments, graph.circular_segments(a.edges), with_sequence=True).orderBy("header").collect()
    assert [(r.header, r.comment, r.len, r.gc, r.soft_masked, r.circular) for r in rows] == [("a", "hi", 8, 50.0, 4, True), ("b", "", 4, 100.0, 0, False), ("c", "", 4, 0.0, 0, False)]
    table = stats.path_table(a.paths, stats.path_report(stats.placed(a.components, a.segments, a.gaps)), spark.createDataFrame([("q",)], "path string")).orderBy("header").collect()
    assert [(r.header, r.length, r.circular) for r in table] == [("p", 21, False), ("q", 4, True)]
    for target, form in (("fa", "fasta"), ("x/y.fastq.gz", "fastq"), ("gfa2", "gfa2"), ("/tmp/o.vcf", "vcf")):
        assert sinks.format_of(target)[0] == form
    out = str(tmp_path / "out.fa.gz")
    sinks.write_assembly(a, out)
    back = readers.read_fasta(spark, out).select("header", "sequence").orderBy("header").collect()
    assert [tuple(r) for r in back] == [("p", "ACGTacgtGGNNNNNAAAA"), ("q", "GGGG")]
    assert [r.gzip for r in readers.is_gzip(spark, out + "/*.gz").collect()][:1] == [True]
    assert sinks.write_assembly(a, "gfa").filter("line LIKE 'P%'").count() == 2 and sinks.write_assembly(a, "vcf").count() == 4
    hc = readers.read_assembly(spark, out, hc_cutoff=1).segments.select("sequence").collect()
    assert {"ACGTacgtG", "A", "G"} == {r.sequence for r in hc}
    assert readers.file_md5(spark, str(tmp_path / "x.gfa")).filter(F.length("md5") == 32).count() == 1
    agp = spark.createDataFrame([("o", 1, "W", "a", "1", "4", "+")], "object string, line_no long, ctype string, c6 string, c7 string, c8 string, c9 string")
    own = spark.createDataFrame([("a_path", 1, "SEGMENT", "a", "+", 0, 0, 8)], "path string, ord long, ctype string, comp string, orientation string, start long, end long, len long")
    placed, missing = readers.apply_agp(own, agp, discovered=True)
    assert placed.count() == 1 and missing.count() == 0 and readers.apply_agp(own, agp)[1].count() == 1


def test_gfa_lines_by_kind_are_not_sorted(spark, tmp_path):
    """A file of each kind is open at once, so a task holds no lines; the setting is put back, and lines keep their order."""
    path = str(tmp_path / "kinds")
    kinds = ["S", "J", "P", "L"]
    lines = spark.range(0, 4000, 1, 2).selectExpr("concat('x', id) value", "id n", f"element_at(array({', '.join(map(repr, kinds))}), cast(id % 4 as int) + 1) kind")
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    readers._write_by_kind(lines, path)
    assert spark.conf.get(key, None) == before
    held = spark.read.parquet(path)
    assert sorted((r.value, r.n, r.kind) for r in held.collect()) == sorted((f"x{i}", i, kinds[i % 4]) for i in range(4000))


def test_gaps_know_their_neighbours_without_a_window(spark):
    """Neighbours of gaps come with their runs: no shuffle, and rows do not carry their record's array."""
    from contigua.operators import ingest

    gaps = ingest.gaps_of(ingest.features(spark.createDataFrame([("r", "NNACNGT"), ("s", "ACN"), ("t", "NN"), ("u", ""), ("v", None)], "header string, sequence string")))
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = sorted(map(tuple, gaps.select("name", "s1", "s2", "s2_or").collect()))
    assert got == [("r.1", "r.2", "r.2", "+"), ("r.3", "r.2", "r.4", "+"), ("s.2", "s.1", "s.1", "-"), ("t.1", None, None, "+")]


def test_tokens_without_a_slice_are_not_searched(spark):
    """A name with at most one sign is taken apart without the pattern, with what the pattern gives."""
    import re

    tokens = ["a", "a+", "gap_1_2", "x.1-", "a+-", "a-b+", "+", "-", "", "a(5:9)+", "a+(5:9)", "(1:2)", "a:b|c#1-", "a b+", "é-"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    name, sign, start, end = readers._token(F.col("t"))
    got = [tuple(r) for r in df.orderBy("i").select(name, sign, start, end).collect()]
    groups = [re.match(readers._TOKEN, t).groups(default="") for t in tokens]
    assert got == [(g[0], g[1] + g[4], int(g[2] or 0), int(g[3] or 0)) for g in groups]


def test_lines_of_orders_are_made_once(spark, monkeypatch):
    """Gaps, edges and components of the orders' GFA files come from one table of lines."""
    from contigua.plans import bridge, catalog

    calls, lines = [], bridge.lines
    monkeypatch.setattr(bridge, "lines", lambda *a: calls.append(a) or lines(*a))
    assert catalog.queries()["read_gfa2_paths"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
