"""FASTQ in byte ranges: any cut of a file gives the same records."""

import gzip
import io
import random

import pytest

from contigua.sources import fastq, readers

COLUMNS = ("header", "comment", "sequence", "quality")


def made(n, rng, end="\n"):
    """Qualities that begin with the marks of other lines, empty reads, blank lines between records."""
    rows, text = [], ""
    for i in range(n):
        size = rng.choice([0, 1, 5, 30])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = "".join(rng.choice("@+!I") for _ in range(size))
        comment = rng.choice(["", "x y", "+ @"])
        rows.append((f"r{i}", comment, seq, qual))
        text += end * rng.choice([0, 0, 0, 1]) + f"@r{i}{' ' if comment else ''}{comment}{end}{seq}{end}+{rng.choice(['', f'r{i}'])}{end}{qual}{end}"
    return rows, text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cut_gives_the_same_records(end, monkeypatch):
    rng = random.Random(5)
    rows, text = made(40, rng, end)
    raw = text.encode()
    for step in (1, 7, 64, 1000, len(raw)):
        for block in (3, 1 << 20):
            monkeypatch.setattr(fastq, "BLOCK", block)
            got = []
            for a in range(0, len(raw), step):
                got += fastq.records(fastq.lines(io.BytesIO(raw), a), min(a + step, len(raw)), a > 0, "x")
            names = [(h.decode().partition(" ")[0], h.decode().partition(" ")[2], s.decode(), q.decode()) for _, h, s, q in got]
            assert names == rows and [raw[p : p + 1] for p, *_ in got] == [b"@"] * len(rows)


def test_faults():
    run = lambda raw: list(fastq.records(fastq.lines(io.BytesIO(raw), 0), len(raw), False, "x"))
    with pytest.raises(ValueError, match="ends inside"):
        run(b"@a\nAC\n+\n")
    with pytest.raises(ValueError, match="no FASTQ record"):
        run(b"@a\nAC\nAC\nAC\n")
    assert run(b"") == [] and run(b"\n\n") == []


def test_source(spark, tmp_path):
    rng = random.Random(6)
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for f in range(3):
        rows, text = made(200, rng)
        want += [(f"{f}{h}", *rest) for h, *rest in rows]
        text = text.replace("@r", f"@{f}r")
        (folder / f"{f}.fastq").write_bytes(gzip.compress(text.encode()) if f == 1 else text.encode())  # zipped whatever its name
    df = readers.read_fastq(spark, str(folder), 1000)
    assert df.rdd.getNumPartitions() > 12
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r[c] for c in COLUMNS) for r in df.orderBy("seq_pos").collect()] == want
    assert [tuple(r[c] for c in COLUMNS) for r in readers._fastq_by_file(spark, str(folder / "0.fastq")).orderBy("seq_pos").collect()] == [w for w in want if w[0][0] == "0"]
    with pytest.raises(FileNotFoundError):
        readers.read_fastq(spark, str(tmp_path / "none"))
    (tmp_path / "empty.fastq").write_bytes(b"")
    assert readers.read_fastq(spark, str(tmp_path / "empty.fastq")).collect() == []
