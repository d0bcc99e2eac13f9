"""Token counts, SimHash, decontamination, passages, classifier, mixing: against brute force and libraries."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from contigua.operators.components import component_labels
from contigua.llm import decontaminate, kneser_ney, mixing, simhash, suffix_dedup, token_counts

VOCAB = public_tokenizers.path("word_bpe_49k.json")
COUNTER = token_counts.MergeCounter(open(VOCAB, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(VOCAB)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", lambda _: "s")(i) if callable(more.get("source")) else "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


# -- token counts -----------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aAbé'sΣİ <|endoftx>\x1c\x85 　\n12ß", max_size=60))
def test_tokens_as_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_tokens_of_rare_characters():
    """Letters that are newer than the library's Unicode, on either side of known ones."""
    for text in ("\u00c2\U0003d000", "a\U0003d000b", "\u0558a\ua7ce", "1\U00011de01", "\u00e9\U000323b0!", "\u4e00\u3400a\u0ca5", "x\u00b2\u2160y", "'s\u0660's"):
        assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), text


def test_tokens_query(spark):
    texts = [None, "", " \n ", "Hello world's 42", "<|endoftext|>", "naïve " * 900, "x" * 20_000, "same", "same"]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, VOCAB).collect()}
    for i, t in enumerate(texts):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(df.limit(0), VOCAB).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, radius):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_near_duplicates(spark):
    rng = random.Random(5)
    base = [words(rng, n) for n in (200, 40, 12, 3)]
    texts = [None, "", " \t", "ÉA b", *base, *base]
    long = words(rng, 600).split()
    for i in range(40):
        some = list(long)
        some[i * 7] = f"edit{i}"
        texts.append(" ".join(some))
    texts += [words(rng, 60) for _ in range(100)]
    df = docs(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df.union(df.limit(3))).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(fps, 4)
    assert got == {i: (format(fps[i], "016x"), comp[i]) for i in fps}
    assert len(set(comp.values())) < len(texts) - 30
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df.union(df.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values())) and kept.columns == df.columns


def test_stages_with_null_and_repeated_ids(spark):
    rng = random.Random(23)
    texts = [words(rng, 80, 5000) for _ in range(6)]
    item = words(rng, 20, 5000)
    ids = [None, None, None, 7, 7, 1]
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]
    rows += [(None, texts[5], "en", "s", 0), (7, texts[3], "en", "s", 0)]  # copies
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(zip(ids, texts))
    bad = [(None, f"{texts[0]} {item} {texts[1]}", "en", "s", 0), (7, item, "en", "s", 0)]
    left = decontaminate.drop_contaminated(spark.createDataFrame(rows + bad, DOCS), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in rows) and left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_keeping_one_row_loses_no_other(spark):
    """Unrelated texts with null and repeated ids, and with columns of the names used inside, all stay."""
    rng = random.Random(31)
    ids = [None] * 5 + [7] * 3 + list(range(10, 15))
    df = docs(spark, [words(rng, 50, 5000) for _ in ids])
    df = spark.createDataFrame([(i, *r[1:]) for i, r in zip(ids, df.collect())], DOCS).withColumn("node", F.lit(1)).withColumn("label", F.lit("x"))
    for options in ({}, {"shingle": 5, "radius": 24, "similarity": 0.8}):
        kept = simhash.keep_one(df, **options)
        assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("bucket", [4096, 5])
def test_buckets_lose_no_link(spark, bucket, monkeypatch):
    """A chain of edits, a passage that many documents share, and buckets dealt in chunks."""
    monkeypatch.setattr(simhash.candidates, "__defaults__", (bucket,))
    monkeypatch.setattr(simhash.links_within, "__defaults__", (bucket,))
    rng = random.Random(41)
    text, texts = words(rng, 120, 5000).split(), []
    for i in range(60):
        text = [*text]
        text[rng.randrange(120)] = f"edit{i}"
        texts.append(" ".join(text))
    passage = words(rng, 60, 5000)
    texts += [f"{passage} {words(rng, 40, 5000)}" for _ in range(80)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    kept = simhash.keep_one(docs(spark, texts), shingle=5, radius=24, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up))


def test_tree_finds_what_no_common_hash_tells(spark):
    """Two pairs of similarity 20/24 whose least hashes agree in none of ten pairs, which buckets of such pairs lost."""
    lines = [[f"s{seed}w{i}" for i in range(28)] for seed in (32096, 116581)]
    df = docs(spark, [" ".join(w[:n]) for w in lines for n in (28, 24)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]


@pytest.mark.parametrize("radius, bucket", [(24, 50), (4, 10)])
def test_near_fingerprints_meet_once(spark, radius, bucket):
    """Each pair within the radius is in one pair of pieces, also of a leaf of equal fingerprints that the tree cannot split."""
    rng = np.random.default_rng(3)
    fps = np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), np.full(120, 5, np.uint64)])
    fps[200:300] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    rows = [(int(node), int(fp), 0, 0, 0, 9, int(node)) for node, fp in zip(rng.permutation(len(fps)) * 7919, fps)]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in simhash.DEALT))
    met, held, of = Counter(), defaultdict(list), {r[0]: r[1] for r in rows}
    for r in simhash.dealt(nodes, radius, bucket).collect():
        assert r.side in (r.lo, r.hi)
        held[r.lo, r.hi].append((r.node, r.side))
    for (lo, hi), own in held.items():
        assert len(own) == len(set(own)) and max(Counter(side for _, side in own).values()) <= 3 * bucket
        met.update(frozenset((x, y)) for x, s in own for y, t in own if x < y and (lo == hi or s != t))
    near = {frozenset((x, y)) for x in of for y in of if x < y and (of[x] ^ of[y]).bit_count() <= radius}
    assert all(met[pair] == 1 for pair in near) and max(met.values()) == 1


def test_pipeline_drops_similar_documents(spark):
    rng = random.Random(29)
    texts = [None, "", "a b", "A  b", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for n in (30, 100, 400):
        base = words(rng, n, 5000).split()
        for edits in (0, 1, n // 90, n // 45, n // 30, n // 10):
            some = list(base)
            for e in range(edits):
                some[rng.randrange(n)] = f"edit{e}x{rng.random()}"
            texts.append(" ".join(some))
    texts += [words(rng, 60, 5000) for _ in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    df = docs(spark, texts)
    kept = corpus_pipeline.near_duplicates(spark, df.union(df.limit(3)), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up)) and kept.columns == df.columns
    assert len(set(up)) < len(simhash.keep_one(df).collect())
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_shards_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fps[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    chain = [fps[0]]
    for i in range(200):  # a chain whose ends lie far apart
        chain.append(chain[-1] ^ np.uint64(0b111 << (i * 3 % 61)))
    every = np.unique(np.concatenate([fps, near, np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    labels = {r.node: r.label for r in component_labels(simhash.near_links(df, 4, leaf_target=64))[0].collect()}
    comp = brute_components({int(x): int(np.uint64(x)) for x in every}, 4)
    groups, ours = defaultdict(set), defaultdict(set)
    for x, c in comp.items():
        groups[c].add(x)
    for x in every:
        ours[labels.get(int(np.int64(x.view(np.int64))), int(x.view(np.int64)))].add(int(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


# -- decontamination --------------------------------------------------------------------------------


def brute_items(text, items):
    h, n = decontaminate.shingle_hashes(text, 5)
    own = re.sub(r"[^a-z0-9]", " ", (text or "").lower()).split()
    out = set()
    for i, t in items:
        g, m = decontaminate.shingle_hashes(t, 5)
        if 0 < m < 5:  # word for word
            if any(own[a : a + m] == t.split() for a in range(len(own))):
                out.add(i)
            continue
        w, theirs = min(len(g), len(h)), Counter(g.tolist())
        for at in range(len(h) - w + 1 if m else 0):
            ours = Counter(h[at : at + w].tolist())
            if w and (ours & theirs).total() >= 0.8 * (ours | theirs).total() - 1e-12:
                out.add(i)
    return out


def test_contaminations(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.choice((3, 14, 25, 40, 70)))) for i in range(40)] + [(40, None), (41, ""), (42, words(rng, 5))]
    texts = [None, "", "a b"]
    for i, t in items[:40]:
        if i % 4 == 0:
            texts.append(words(rng, 300) + " " + t.upper() + "! " + words(rng, 200))
        if i % 4 == 1:  # one word changed near an end
            w = t.split()
            w[-1] = "other"
            texts.append(" ".join(w) + " " + words(rng, 50))
        if i % 4 == 2:
            texts.append(words(rng, 30) + " " + " ".join(t.split()[: len(t.split()) // 2]) + " " + words(rng, 30))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(set)
    for r in decontaminate.contaminations(docs(spark, texts), bench).collect():
        got[r.doc_id].add(r.item_id)
        assert r.similarity >= 0.8
    expected = {i: x for i, t in enumerate(texts) if (x := brute_items(t, items))}
    assert got == expected and len(expected) > 10
    some = decontaminate.contaminations(docs(spark, texts), bench, chunk_bytes=2000)
    assert {(r.doc_id, r.item_id) for r in some.collect()} == {(d, i) for d, x in expected.items() for i in x}
    assert decontaminate.contaminations(docs(spark, texts), bench.limit(0)).count() == 0
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - set(expected)


def test_short_items_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    rng = random.Random(59)
    item, other = words(rng, 40, 5000), words(rng, 25, 5000)
    long = " ".join([words(rng, 30, 5000), *[item] * 30, words(rng, 500, 5000), other, words(rng, 70, 5000), item])
    df = docs(spark, [long, "so Three, BLIND mice ran", "three blind", "mice"]).withColumn("item_id", F.lit("x")).withColumn("similarity", F.lit(0))
    bench = spark.createDataFrame([(1, item), (2, other), (3, "three blind mice"), (4, "mice"), (None, "mice"), (5, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.word_start, r.n_words) for r in decontaminate.contaminations(df, bench).collect())
    expected = [(0, 1, 30 + 40 * i, 40) for i in range(30)] + [(0, 2, 1730, 25), (0, 1, 1825, 40), (1, 3, 1, 3), (1, 4, 3, 1), (1, None, 3, 1), (3, 4, 0, 1), (3, None, 0, 1)]
    assert got == Counter(expected)
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns


def test_block_index_finds_all():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = np.concatenate([fps[:50] ^ np.uint64(0xF0F0), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    q, i, d = decontaminate.BlockIndex(fps, 18).near(queries)
    full = np.bitwise_count(queries[:, None] ^ fps[None, :])
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full <= 18)))) and (full[q, i] == d).all()


# -- repeated passages ------------------------------------------------------------------------------


def brute_passages(texts, n=50):
    own, out = defaultdict(set), set()
    split = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    for i, w in split.items():
        for s in range(len(w) - n + 1):
            own[tuple(w[s : s + n])].add(i)
    for i, w in split.items():
        at = None
        for s in range(len(w) - n + 1):
            if len(own[tuple(w[s : s + n])]) > 1:
                if at and s <= at[1]:
                    at[1] = s + n
                else:
                    out |= {(i, *at)} if at else set()
                    at = [s, s + n]
        out |= {(i, *at)} if at else set()
    return out


@pytest.mark.parametrize("run_rows", [1000, 8])
def test_repeated_passages(spark, run_rows):
    rng = random.Random(11)
    shared = [words(rng, n, 5000) for n in (50, 51, 60, 90, 200, 49, 30)]
    texts = [None, "", "short text", "la " * 300, "la " * 300]
    for i in range(60):
        texts.append(" ".join(x for _ in range(2) for x in (words(rng, rng.randrange(0, 80), 5000), rng.choice(shared))) + " " + words(rng, rng.randrange(60), 5000))
    texts += [texts[10], texts[10]]
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, texts), run_rows=run_rows).collect()}
    assert got == brute_passages(texts)
    assert suffix_dedup.repeated_passages(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("run_rows", [1000, 6])
def test_periodic_passages(spark, run_rows, monkeypatch):
    """Lines over and over with periods of one and more words, in few and many documents, and texts of several stretches."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", 2000)
    monkeypatch.setattr(suffix_dedup, "ROW_BYTES", 20_000)
    rng = random.Random(43)
    three, ten = "one two three", words(rng, 10, 5000)
    texts = [f"{words(rng, 20 + i, 5000)} {three} {' '.join([three] * (300 + i))} {words(rng, 30, 5000)}" for i in range(8)]
    texts += [f"{words(rng, 5, 5000)} {' '.join([ten] * (100 + 7 * i))} {words(rng, 90, 5000)}" for i in range(8)]
    texts += [" ".join([words(rng, 4, 5000)] * 400), "word " * 500, words(rng, 900, 5000)]
    texts += [texts[-1][200:4000], f"{texts[-1][:1500]} {words(rng, 100, 5000)}"]
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, texts), run_rows=run_rows).collect()}
    assert got == brute_passages(texts)


@pytest.mark.parametrize("many", [1, 1000])
def test_passages_with_null_and_repeated_ids(spark, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(47)
    shared, copy = words(rng, 60, 5000), words(rng, 70, 5000)
    texts = [f"{words(rng, 9, 5000)} {shared}", f"{shared} {words(rng, 5, 5000)}", copy, copy, copy, shared[:-1]]
    ids = [None, None, None, 5, 5, 6]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).withColumn("word_start", F.lit("x")).withColumn("key", F.lit(1))
    got = Counter(tuple(r) for r in suffix_dedup.repeated_passages(df).collect())
    assert got == Counter([(None, 9, 69), (None, 0, 60), (None, 0, 70), (5, 0, 70), (6, 0, 59)])


def test_passage_of_frequent_lines(spark):
    rng = random.Random(31)
    lines = [words(rng, 40, 5000) for _ in range(8)]
    texts = [f"{words(rng, 30, 5000)} {rng.choice(lines)} {words(rng, 30, 5000)}" for _ in range(240)]
    for a, b in zip(lines[::2], lines[1::2]):  # two documents alone hold both lines, one after the other
        texts += [f"{words(rng, 60, 5000)} {a} {b} {words(rng, 60, 5000)}" for _ in range(2)]
    texts += [f"{lines[0]} {lines[1]}"]
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, texts), run_rows=5).collect()}
    assert got == brute_passages(texts) and len(got) == 9


# -- quality ----------------------------------------------------------------------------------------


def brute_kneser_ney(texts, order=3):
    """Modified Kneser-Ney over words by dictionaries."""
    framed = lambda t: [None] * (order - 1) + (t or "").split() + [None]
    tables = {order: Counter()}
    for t in texts:
        a = framed(t)
        tables[order].update(tuple(a[i : i + order]) for i in range(len(a) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    found = {}
    for k, table in tables.items():
        n = [sum(c == i for c in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0] + [min(i, max(0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[1] else (0, 0.5, 1.0, 1.5)[i] for i in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        found[k] = (table, d, total, left)

    def p(g):
        if not g:
            return 1 / kneser_ney.CLASSES
        table, d, total, left = found[len(g)]
        c, t = table[g], total[g[:-1]]
        return (max(c - d[min(c, 3)], 0) / t + left[g[:-1]] / t * p(g[1:])) if t else p(g[1:])

    def perplexity(t):
        a = framed(t)
        logs = [np.log(p(tuple(a[i : i + order]))) for i in range(len(a) - order + 1)]
        return float(np.exp(-np.mean(logs)))

    return perplexity


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("sizes", [{}, {"shard_words": 300, "list_words": 10**9}, {"shard_words": 300, "list_words": 40}])
def test_perplexity_as_brute_force(spark, monkeypatch, sizes, order):
    """Also with many shards, copies of them, hot words and a hot pair, blocks and stretches that cut texts."""
    rng = random.Random(13)
    train = [words(rng, 60, 30) + " of the " * rng.randrange(9) + words(rng, 9, 30) for _ in range(40)]
    other = ["", None, "ÉÉ ###", words(rng, 3000, 30), "of the " * 400, train[0]]
    monkeypatch.setattr(kneser_ney, "BLOCK_WORDS", 500)
    monkeypatch.setattr(kneser_ney, "STRETCH", 3000)
    monkeypatch.setattr(kneser_ney, "SAMPLE", 1)
    rows = kneser_ney.prepared(docs(spark, train + other), "doc_id", "text", "lang")
    known = rows.filter("doc < 40")
    if len(sizes) and sizes["list_words"] == 40:
        plan = kneser_ney.planned(rows, known, **sizes)
        assert plan.n["=en"] > 1 and plan.hot["=en"] and plan.pairs["=en"]
    scored = kneser_ney.perplexities(rows, known, order, **sizes).join(rows.select("k1", "k2", "doc"), ["k1", "k2"])
    got = {r.doc: r for r in scored.collect()}
    ppl = brute_kneser_ney(train, order)
    for i, t in enumerate(train + other):
        assert got[i].perplexity == pytest.approx(ppl(t), rel=1e-4) and got[i].n_words == len((t or "").split()) + 1


def test_blocks_of_many_words():
    """More different words in a block than numbers: it is halved, and nothing is lost."""
    run = np.concatenate([[0, 0], np.arange(1, 150_001), [0]]).astype(np.uint64)
    block = kneser_ney.Block("=x", [(1, 1)], [run])
    plan = kneser_ney.Plan({"=x": (10, 10)}, {}, {}, 2, 10)
    got = []
    for shard, _, piece in kneser_ney.lists(block, plan, 0):
        middle, last, first, _, n = kneser_ney.unpacked(piece)
        assert (plan.shards("=x", middle) == shard).all() and (n == 1).all()
        got += zip(first.tolist(), middle.tolist(), last.tolist())
    assert sorted(got) == sorted(zip(run[:-2].tolist(), run[1:-1].tolist(), run[2:].tolist()))


def test_classifier_with_nulls_and_repeated_rows(spark):
    rng = random.Random(53)
    text = [words(rng, 40, 30) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(text)] + [(None, text[3], "en"), (None, None, None), (3, None, "en"), (70, text[4], None), (71, text[4], "")]
    schema = "doc_id long, text string, lang string"
    trusted = spark.createDataFrame([(i,) for i in range(50)] + [(None,), (70,)], "doc_id long")
    once = kneser_ney.classify(spark.createDataFrame(rows, schema), trusted).collect()
    more = spark.createDataFrame(rows + [rows[3]] * 2 + [rows[60]] + [rows[61]], schema).withColumn("k1", F.lit("x")).withColumn("shard", F.lit(0)).repartition(3)
    again = kneser_ney.classify(more, trusted).collect()
    near = lambda found: sorted((str(r.doc), str(r.lang), r.n_words, r.perplexity and round(r.perplexity, 3), r.keep) for r in found)
    assert len(once) == len(rows) and near(once) == near(again)
    by_lang = {(r.doc, r.lang): r.perplexity for r in once if r.doc in (70, 71)}
    assert by_lang[71, ""] is None and (70, None) in by_lang
    kept = kneser_ney.keep_good(more, trusted)
    assert kept.columns == more.columns and kept.count() == sum(r.keep for r in once) + 4


def test_classifier(spark):
    rng = random.Random(17)
    prose = [" ".join(rng.choice(("the", "cat", "sat", "on", "a", "mat", "dogs", "were", "here")) for _ in range(rng.randrange(60, 300))) for _ in range(400)]
    junk = [" ".join(f"{w}{rng.choice('#$%')*3}" for w in p.split()) for p in prose[:40]] + [p.upper() + "!!" for p in prose[40:60]]
    df = docs(spark, prose + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(401, None, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.keep_good(df, kneser_ney.trusted_ids(labels)).collect()}
    held_out = set(range(300, 400))
    assert len(kept & held_out) >= 98 and not kept & set(range(400, 460))
    nobody = kneser_ney.keep_good(df, kneser_ney.trusted_ids(labels.limit(0)))
    assert nobody.count() == df.count() and nobody.columns == df.columns
    assert kneser_ney.keep_good(df.limit(0), kneser_ney.trusted_ids(labels)).count() == 0


def test_languages_with_few_rows_have_fences(spark):
    rng = random.Random(37)
    rows, spoilt = [], []
    for lang, vocabulary, n in (("en", "the cat sat on a mat dogs were here".split(), 600), ("de", "die katze lag auf einer matte hunde waren hier".split(), 100)):
        for _ in range(n):
            rows.append((" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))), lang))
        for t, _ in rows[-30:]:
            spoilt.append((" ".join(w[::-1] if i % 12 == 0 else w for i, w in enumerate(t.split())), lang))
    every = rows + spoilt
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(every)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.keep_good(df, kneser_ney.trusted_ids(labels)).collect()}
    assert len(kept & set(range(len(rows)))) >= 0.98 * len(rows) and not kept & set(range(len(rows), len(every)))


# -- mixing -----------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(19)
    names = ["a", "B", "é", "z", None, "tiny", "empty"]
    rows = []
    for i in range(3000):
        s = names[0] if i % 3 == 0 else rng.choice(names[:5])
        rows.append((i, words(rng, rng.randrange(0, 40)) if i % 50 else None, s))
    rows += [(3000, "one", "tiny"), (3001, "two three", "tiny"), (3002, None, "empty"), (3003, "same", "a"), (3003, "same", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("target", F.lit("x"))
    plan = mixing.plan_mix(mixing.sizes_of(df)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    target = brute_targets(dict(total))
    assert len(plan) == len(rows)
    taken = Counter()
    for r in plan:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in total:
        assert abs(taken[s] - target[s]) <= max(41, 0.02 * target[s]), s
    again = mixing.plan_mix(mixing.sizes_of(df.repartition(7))).collect()
    key = lambda p: sorted(((r.doc_id, r.size, r.copies) for r in p))
    assert key(plan) == key(again)
    marked = df.select(*df.columns, F.monotonically_increasing_id().alias("n"), F.create_map(F.lit("a"), F.col("size")).alias("m"))
    assert {r.n for r in mixing.mix(marked.filter("doc_id = 3003").withColumn("source", F.lit("s"))).collect()} == {r.n for r in marked.filter("doc_id = 3003").collect()}  # rows that differ elsewhere
    mixed = mixing.mix(df)
    by_id = Counter()
    for r in plan:
        by_id[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +by_id and mixed.columns == df.columns
    assert mixing.plan_mix(mixing.sizes_of(df.limit(0))).count() == 0
    assert os.path.exists(VOCAB)
