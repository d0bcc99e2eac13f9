"""Packing, vector codes and conversation repair against brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contigua.llm import conversation_repair as C, pattern_packing as P, queries, vector_codes as V
from contigua.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


# -- packing ------------------------------------------------------------------------------------------


def check_packing(rows, pieces_of, limit=2048):
    """Rows hold every piece, gapless from 0 in sequences within the limit."""
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in pieces_of.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(places)


def expected_pieces(docs, tokenizer, limit=2048):
    want = defaultdict(list)
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), limit)):
            own = ids[at : at + limit]
            want[doc].append((piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    return want


def test_packing_query(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    want = expected_pieces(docs, tokenizer)
    out = queries.op11_pattern_packing(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    least = -(-sum(p[2] for own in want.values() for p in own) // 2048)
    assert least <= check_packing(out.collect(), want) <= least + 1


def test_packing_odd_rows(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "  \t "), (4, "word " * 5000), (5, "a"), (5, "a"), (6, "<|endoftext|> x<|startoftext|>"), (7, "\x1cA\x1dB é ÉΣ ſ"), (None, "no id"), (8, "x" * 200), (9, "漢字" * 300)]
    df = spark.createDataFrame(docs, DOC).withColumn("sequence_id", F.lit("other")).withColumn("length", F.lit(-1))
    pieces = P.cut_documents(df, WORDS)
    rows = P.pack(pieces.withColumn("ids_crc32", F.crc32("ids"))).collect()
    check_packing(rows, expected_pieces(docs, tokenizer))
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    assert P.pack(P.cut_documents(spark.createDataFrame([], DOC), WORDS)).collect() == []


def test_packing_hot_length(spark):
    """Two thirds of all pieces have one length."""
    rng = random.Random(3)
    pieces = [(i, 700 if i % 3 else rng.randint(1, 2048)) for i in range(3000)]
    rows = P.pack(spark.createDataFrame(pieces, "id long, length long").repartition(7)).collect()
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.id, r.length) for r in rows) == pieces
    for own in used.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 3000)], "id long, length long"))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_places_everything(histogram):
    runs, sequences = P.plan(histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    assert -(-total // 64) <= sequences <= sum(histogram.values())
    seen, filled = defaultdict(int), defaultdict(list)
    for i, (length, first, each, seq, offset) in enumerate(runs.tolist()):
        stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else histogram[length]
        assert first == seen[length]
        for rank in range(first, stop):
            nth = rank - first
            filled[seq + nth // each].append((offset + nth % each * length, length))
        seen[length] = stop
    assert dict(seen) == histogram and sorted(filled) == list(range(sequences))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_least_squares_is_optimal():
    """Gradients vanish where x > 0 and point outward where x = 0; exact patterns are found again."""
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(40, 0, -1), rng.integers(1, 300, 40)
    places, copies = P.patterns(lengths, counts, 64)
    full = np.where(places < 0, 0, lengths[np.where(places < 0, 0, places)])
    assert ((full * copies).sum(1) == 64).all()
    x = P.least_squares(places, copies, counts, 20_000)
    a = np.zeros((40, len(x)))
    for j in range(len(x)):
        for p, c in zip(places[j], copies[j]):
            if p >= 0:
                a[p, j] += c
    slope = a.T @ (a @ x - counts)
    assert slope.min() > -0.05 and np.abs(slope[x > 0.01]).max() < 0.05
    repeats, left = P.rounded(x, places, copies, counts)
    assert (left >= 0).all() and (a @ repeats + left == counts).all()


# -- vector codes ---------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """By full search in Python integers; rows are (id, vector, label)."""
    rows = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in rows), default=0)
    size = max(1, -(-dims // parts))
    rows = [(i, v + [0] * (size * parts - len(v)), lab) for i, v, lab in rows]
    seeds = {}
    for i, v, _ in rows:
        if i is not None:
            seeds[i] = min(seeds.get(i, v), v)
    first = [seeds[i] for i in sorted(seeds)[:entries]]
    books = [[v[p * size : (p + 1) * size] for v in first] for p in range(parts)]

    def assign(v, p):
        own = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(own, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in rows:
                own[assign(v, p)[1]].append(v[p * size : (p + 1) * size])
            fresh.append([[sum(c) // len(c) for c in zip(*own[e])] if e in own else entry for e, entry in enumerate(books[p])])
        books = fresh
    out, sums = [], defaultdict(int)
    for i, v, lab in rows:
        found = [assign(v, p) for p in range(parts)]
        sums[lab] += sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, d, sums[lab], sha) for i, c, d, lab in out), key=repr)


def coded(df, **kw):
    books = V.train(df, **kw)
    return V.with_label_error(V.encode(df, books)).select("vec_id", "code", "error", "label_error", F.lit(V.digest(books)).alias("sha"))


def test_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SMALL, "embeddings").collect()]
    out = queries.op12_vector_codes(spark, SMALL)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_codes(rows)


def test_codes_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = lambda n=16, s=1.0: [float(np.float32(x)) for x in rng.normal(0, s, n)]
    rows = [(i, v(), i % 3) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0] * 15 + [None], 1), (62, [float("nan")] * 16, 2), (63, [float("inf")] + [0.0] * 15, None), (64, v(), None), (65, v(), None), (None, v(), 7), (3, rows[3][1], 0), (3, rows[3][1], 0), (66, [], 1), (67, v(5), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).repartition(5)
    assert sorted(map(tuple, coded(df).collect()), key=repr) == plain_codes(rows)
    big = [(i, [x * 1e9 for x in v()], None) for i in range(30)]
    big = [(i, [float(np.float32(x)) for x in u], lab) for i, u, lab in big]
    got = sorted(map(tuple, coded(spark.createDataFrame(big, "vec_id long, embedding array<float>, label int")).collect()), key=repr)
    want = plain_codes(big)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want] and [g[2] for g in got] == [min(w[2], (1 << 63) - 1) for w in want]
    assert coded(spark.createDataFrame(rows[:5], df.drop("code").schema)).count() == 5
    assert coded(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_codes_hot_labels(spark, monkeypatch):
    """Labels beyond the bound of a broadcast: the hot ones apart."""
    rows = [(i, [float(i % 7)] * 8, 1 if i % 3 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, coded(df).collect()), key=repr)
    monkeypatch.setattr("contigua.llm.common.MOST_BROADCAST", 64)
    assert sorted(map(tuple, coded(df).collect()), key=repr) == want == plain_codes(rows)


def test_partial_distances_prune_and_agree():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-4000, 4000, (500, 8)), rng.integers(-4000, 4000, (16, 8))
    book[3] = book[9]
    best, least, work = V.nearest(x, book)
    full = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (least == full.min(1)).all() and work < full.size * 8


# -- conversation repair ----------------------------------------------------------------------------------


def best_edits(turns):
    """(cost, audit) by trying all edits; turns are (initial, must go, truncated)."""
    from functools import cache

    @cache
    def go(i, q, spare):
        found = [(0, "")] if i == len(turns) and q in (0, 3) else []
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        if spare:
            for role in "ua":
                if (q, role) in step:
                    add(2, "I", go(i, step[q, role], spare - 1))
        if i < len(turns):
            initial, gone, cut = turns[i]
            add(3, "D", go(i + 1, q, spare))
            if not gone:
                if (q, initial) in step:
                    add(cut, "K", go(i + 1, step[q, initial], spare))
                for role in "ua":
                    if (q, role) in step:
                        add(2 + cut, "R", go(i + 1, step[q, role], spare))
        return min(found, default=None)

    return go(0, 0, 2 * len(turns) + 2)


TURNS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "", "x"]), st.booleans(), st.booleans()), max_size=9)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_edits_are_the_least(turns):
    assert C.repaired(turns) == best_edits(tuple(turns))


def plain_repair(rows, harm=True):
    """Per conversation the row of the contract; rows are (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        if hit == 0:
            continue
        text = "" if hit == 1 else text.translate({ord(c): None for c in ".!?"}) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            ink = text.strip(" \t\n\x0b\x0c\r")
            blank, again, cut = not ink, (role, text) in seen, bool(ink) and ink[-1] not in ".!?"
            seen.add((role, text))
            for k, v in enumerate((blank, again and not blank, cut and not again)):
                counts[k] += bool(v)
            turns.append((role[:1], blank or again, cut))
        cost, audit = best_edits(tuple(turns))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        lines, i, last = [], 0, None
        for letter in audit:
            if letter == "I":
                last = "assistant" if last == "u" else "user"
                lines.append(last + ":")
            else:
                _, role, text = own[i]
                i += 1
                if letter == "D":
                    continue
                last = role if letter == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{last}:{text}")
            last = last[:1]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_conversation_repair(spark, SMALL)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=repr) == plain_repair(rows)


def odd_turns():
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " \t", "What?", "Ends here!", "é. ", "a:b\nc.", None]
    roles = ["user", "assistant", "system", "User", "", None, "tool"]
    rows = [(rng.randint(1, 40), rng.choice([None, *range(12)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randint(0, 99)}.") for _ in range(400)]
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (7, 3, "user", "Yes."), (7, 3, "user", "Yes.")]


def repaired_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, CONV).withColumn("audit", F.lit("x")).withColumn("there", F.lit(5)).repartition(3)
    return sorted(map(tuple, C.digests(C.damaged(C.plain(df)), **kw).collect()), key=repr)


def test_repair_odd_rows(spark):
    rows = odd_turns()
    assert repaired_rows(spark, rows) == plain_repair(rows)
    assert repaired_rows(spark, [(19, t, None, None) for t in range(3)]) == plain_repair([(19, t, None, None) for t in range(3)])
    assert C.digests(C.damaged(C.plain(spark.createDataFrame([], CONV)))).collect() == []


def test_repair_of_long_conversations(spark):
    """In pieces of a few turns, with a hot conversation, the results are those of whole ones."""
    rng = random.Random(4)
    rows = odd_turns() + [(1000, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Same.", "Same", f"{t}."])) for t in range(300)]
    gone = [t for t in range(500) if zlib.crc32(f"77:{t}".encode()) % 20 == 0][:12]
    rows += [(77, t, "user", "x") for t in gone]
    want = plain_repair(rows)
    assert repaired_rows(spark, rows, most_turns=9) == want
    pieces = C.repair(C.damaged(C.plain(spark.createDataFrame(rows, CONV))), most_turns=9).orderBy("conv_id", "piece").collect()
    assert len(pieces) > len(want)
    audit = "".join(r.audit for r in pieces if r.conv_id == 1000)
    assert audit == next(w[7] for w in want if w[0] == 1000) and sum(len(r.repaired) for r in pieces if r.conv_id == 1000) == len(audit) - audit.count("D")
