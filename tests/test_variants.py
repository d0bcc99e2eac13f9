"""Variants laid on paths, and windows over alternatives, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from contigua.model import VARIANTS
from contigua.operators import stats, string_graph, variants
from contigua.sources import sinks

PLACED = "path string, ord long, ctype string, comp string, orientation string, start long, end long, len long, text string"
COMP = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(COMP)


def laid(text, groups):
    """By hand: the best alternative of each group in order, those that begin too early left out."""
    out, at, seen = "", 0, 0
    for pos, n, _, alt in sorted(groups):
        if pos >= seen and pos + n <= len(text):
            out, at = out + text[at:pos] + alt, pos + n
        seen = max(seen, pos + n)
    return out + text[at:]


def test_apply(spark):
    rng = random.Random(5)
    texts = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(60)) for i in range(6)}
    rows, best = [], {}
    for s in texts:
        for grp in range(8):
            pos, options = rng.randint(0, 58), []
            for alt in range(rng.randint(1, 3)):
                vtype = rng.choice(["SNV", "INS", "DEL", "COM"])
                n = {"SNV": 1, "INS": 0, "DEL": rng.randint(1, 3), "COM": rng.randint(0, 3)}[vtype]
                text = "" if vtype == "DEL" else "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 4)))
                rows.append((s, grp, alt, vtype, n, pos, text, float(rng.randint(0, 2))))
                options.append((rows[-1][7], -alt, n, text))
            _, _, n, text = max(options)
            best.setdefault(s, []).append((pos, n, grp, text))
    comps = [("p", 1, "SEGMENT", "s0", "+", 0, 0, 60, texts["s0"]), ("p", 2, "GAP", "g", "0", 0, 0, 5, None), ("p", 3, "SEGMENT", "s1", "-", 0, 0, 60, texts["s1"])]
    comps += [("q", i, "SEGMENT", f"s{i}", "+", 0, 0, 60, texts[f"s{i}"]) for i in range(2, 6)] + [("r", 1, "SEGMENT", "s0", "-", 0, 0, 60, texts["s0"]), ("n", 1, "SEGMENT", "star", "+", 0, 0, 7, None), ("n", 2, "SEGMENT", "free", "+", 0, 0, 4, "ACGT")]
    placed, table = spark.createDataFrame(comps, PLACED), spark.createDataFrame([*rows, ("star", 0, 0, "SNV", 1, 1, "C", None)], VARIANTS)
    edited = variants.apply(placed, table)
    got = {(r.path, r.comp): (r.text, r.len) for r in edited.collect()}
    for path, _, ctype, comp, _, _, _, _, text in comps:
        if ctype == "SEGMENT" and text:
            want = laid(text, best.get(comp, []))
            assert got[path, comp] == (want, len(want))
    assert got["p", "g"] == (None, 5) and got["n", "star"] == (None, 7)
    seq = {r.path: r.seq for r in sinks.path_sequences(edited.filter("path <> 'n'")).collect()}
    assert seq["p"] == laid(texts["s0"], best["s0"]) + "NNNNN" + turned(laid(texts["s1"], best["s1"])) and seq["r"] == turned(laid(texts["s0"], best["s0"]))
    assert sorted(variants.apply(placed, table.limit(0)).collect(), key=str) == sorted(placed.collect(), key=str)
    assert variants.apply(placed.limit(0), table).count() == 0


def test_lines_put_back_give_the_alternative(spark):
    """A line's ALT put in the place of its REF gives the path with that alternative, on either strand and in slices."""
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(40))
    rows, forward = [], {}
    for grp, (pos, vtype, n, alt) in enumerate([(0, "DEL", 2, ""), (5, "SNV", 1, "G"), (10, "INS", 0, "TTA"), (20, "COM", 3, "ACGTA"), (30, "DEL", 4, ""), (36, "DEL", 4, ""), (38, "INS", 0, "C")]):
        rows.append(("s", grp, 0, vtype, n, pos, alt, 1.0))
        forward[grp] = (pos, n, alt)
    comps = [("f", 1, "GAP", "g", "0", 0, 0, 3, None), ("f", 2, "SEGMENT", "s", "+", 0, 0, 40, text), ("t", 1, "SEGMENT", "s", "-", 0, 0, 40, text), ("c", 1, "SEGMENT", "s", "-", 4, 38, 35, text[3:38])]
    off, table = stats.offsets(spark.createDataFrame(comps, PLACED)), spark.createDataFrame(rows, VARIANTS)
    whole = {"f": "NNN" + text, "t": turned(text), "c": turned(text[3:38])}
    lines = variants.on_paths(off, table).collect()
    for r in lines:
        pos, n, alt = forward[r.grp]
        edited = text[:pos] + alt + text[pos + n :]
        want = {"f": "NNN" + edited, "t": turned(edited), "c": turned(edited[3 : 38 + len(alt) - n])}[r.path]
        assert r.ref and whole[r.path][r.pos - 1 : r.pos - 1 + len(r.ref)] == r.ref
        assert whole[r.path][: r.pos - 1] + r.alts[0] + whole[r.path][r.pos - 1 + len(r.ref) :] == want
    assert sorted((r.path, r.grp) for r in lines) == sorted([(p, g) for p in "ft" for g in range(7)] + [("c", g) for g in (1, 2, 3, 4, 6)])  # 6 inserts at the slice's end


@pytest.mark.parametrize("k", [1, 4, 7])
def test_string_windows(spark, k):
    rng = random.Random(k)
    reads, sites, expected = [], [], set()
    for h in range(12):
        seq = "".join(rng.choice("AC") for _ in range(rng.randint(1, 12)))
        places = [[("", b)] for b in seq]
        for pos in rng.sample(range(len(seq)), min(4, len(seq))):
            own = [(str(c), "".join(rng.choice("AC") for _ in range(rng.randint(0, 3)))) for c in range(1, rng.randint(2, 4))]
            sites += [(f"h{h}", pos, int(c), t or None) for c, t in own]
            places[pos] = [("0", seq[pos]), *own]
        reads.append((f"h{h}", seq))
        best = {}
        for pos in range(len(seq)):
            for walk in itertools.product(*places[pos:]):
                for inset in range(len(walk[0][1])):
                    text, choices = "", []
                    for i, (c, t) in enumerate(walk):
                        text += t[inset:] if i == 0 else t
                        choices += [c] if c else []
                        if len(text) >= k:
                            key = (f"h{h}", pos, inset, text[:k])
                            best[key] = min(best.get(key, "~"), ",".join(choices))
                            break
        expected |= {(*key, c) for key, c in best.items()}
    table = spark.createDataFrame([*reads, ("null", None), ("empty", ""), ("bare", "ACACACAC")], "header string, sequence string")
    places = spark.createDataFrame([*sites, ("h0", 99, 1, "A"), ("gone", 0, 1, "A")], "header string, pos long, choice int, text string")
    expected |= {("bare", p, 0, "ACACACAC"[p : p + k], "") for p in range(9 - k)}
    got = [tuple(r) for r in string_graph.string_windows(table, places, k).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert string_graph.string_windows(table.limit(0), places, k).count() == 0 and string_graph.string_windows(table, places.limit(0), k).count() > 0
    with pytest.raises(ValueError):
        string_graph.string_windows(table, places, 0)


def test_many_choices_are_not_multiplied():
    """Forty places with two equal outcomes: 2**40 walks, one window a place."""
    sites = {i: [("0", "A"), ("1", "A")] for i in range(40)}
    assert list(string_graph.windows_from("A" * 40, sites, sorted(sites), 0, 40)) == [(0, "A" * 40, ",".join("0" * 40))]


def test_windows_are_work_of_many_tasks(spark):
    """A few bytes of sequence are much work: adaptive execution must not gather them in one task, and sites pass neither through the driver nor with their sequence."""
    from contigua.plans import catalog

    table = spark.createDataFrame([(f"h{i}", "ACGTTGCAAC") for i in range(64)], "header string, sequence string")
    places = spark.createDataFrame([(f"h{i}", 3, 1, "GG") for i in range(64)] * 3, "header string, pos long, choice int, text string")
    got = string_graph.string_windows(table, places, 4)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == len(set(got.collect())) == 64 * 12
    plan = _plan(catalog.queries()["string_windows"](spark, "/root/testdata/sf0.001"))
    assert "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in plan


def test_windows_beyond_what_is_held_at_once(monkeypatch):
    """Places are swept in halves where their windows are too many, and one place alone however many it has."""
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGé") for _ in range(60))
    sites = {i: [("0", seq[i]), ("1", "TT"), ("10", ""), ("2", "C")] for i in range(1, 60, 3)}
    laid = string_graph._lay([seq], *(f([x for x in ((0, i, c, t) for i in sites for c, t in sites[i][1:])]) for f in (
        lambda r: np.array([x[0] for x in r]), lambda r: np.array([x[1] for x in r]), lambda r: pa.array([x[2] for x in r]), lambda r: pa.array([x[3] for x in r]))), 9)
    want = [(p, *w) for p in range(60) for w in string_graph.windows_from(seq, sites, sorted(sites), p, 9)]
    for cells in (1, 500, 5000, 1 << 22):
        monkeypatch.setattr(string_graph, "CELLS", cells)
        got = [(p, i, w, names[c]) for place, inset, letters, code, names in string_graph._sweep(laid, 0, 60, 9)
               for p, i, w, c in zip(place.tolist(), inset.tolist(), string_graph._strings(letters).to_pylist(), code.tolist())]
        assert sorted(got) == sorted(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_are_dealt_once(spark):
    """Groups of variants are shuffled by segment once; paths are put together without their qualities; gaps meet no variants in a listing."""
    from contigua.plans import catalog

    sf = "/root/testdata/sf0.001"
    laid = _plan(catalog.queries()["path_with_variants"](spark, sf))
    assert laid.count("Exchange hashpartitioning") <= 3 and "repeat(!" not in laid
    assert "Inner" in _plan(catalog.queries()["vcf_out"](spark, sf))
