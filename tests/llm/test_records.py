"""kNN, WARC, compaction, chats and the pipeline: brute force, exact round trips, held-out accuracy."""

import base64
import hashlib
import io
import itertools
import random
import threading
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from contigua.llm import chat, compaction, knn, warc
from contigua.llm.common import scratch, table


# -- kNN --------------------------------------------------------------------------------------------


def brute_knn(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = list(dict((i, v) for i, v in ok).items())
    out = set()
    for q, x in ok:
        if q % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("chunk_rows", [4096, 16])
def test_knn(spark, chunk_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(200)]  # a hot vector
    rows += [(800, None), (850, [None] * 8), (900, [float("nan")] * 8), (950, [float("inf")] + [0.0] * 7), (1000, []), (None, [1.0] * 8), (1050, [1.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("score", F.lit("clash"))
    got = {tuple(r) for r in knn.knn_join(df, F.col("id") % 50 == 0, chunk_rows=chunk_rows).collect()}
    assert got == brute_knn(rows)
    assert knn.knn_join(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = knn.knn_join(df.filter("vec_id IN (0, 1)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def test_knn_with_an_id_repeated(spark):
    rng = random.Random(41)
    first = spark.range(1, 50).orderBy(F.xxhash64("id")).first().id  # the first of the pivots, and every query's best
    rows = [(i, [1.0 + 0.01 * rng.random(), 0.0] if i % 2 else [0.9, 0.1 * rng.random()]) for i in range(50) if i != first]
    df = spark.createDataFrame(rows + [(first, [50.0, 0.0])] * 6, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in knn.knn_join(df, F.col("id") % 50 == 0).collect()}
    assert got == brute_knn([*rows, (first, [50.0, 0.0])]) and len(got) == 5


def test_scores_beyond_doubles():
    q, d = np.array([[2**31, 1]]), np.array([[2**31, 1], [2**31, 2]])
    assert knn.scores(q, d).tolist() == [[2**62 + 1, 2**62 + 2]]
    assert knn.scores(q * 2**31, d * 2**31).tolist() == [[2**63 - 1] * 2]


# -- WARC -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    big = "é" * 400_000 + "".join(random.Random(1).choices("abc<>&", k=300_000))
    rows = [(1, "http://a/ b\r\nX: y", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", "one"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0)).withColumn("sha1", F.lit(0))
    folder = scratch(spark, "warc")
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(spark, folder, manifest, keep_payload=True).collect()
    most = {}
    for i, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if i is None else i)
    expected = sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i == most[h or ""] else ("revisit", most[h or ""]))) for i, _, h in rows), key=repr)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected
    assert {r.id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {7: "same", 4: "", 5: big, 6: "one"}
    monkeypatch.setattr(warc, "HOT_LEAST", 1)
    hot = warc.read_archives(spark, folder3 := scratch(spark, "warc"), warc.write_archives(df, folder3)).collect()
    assert sorted(map(str, hot)) == sorted(map(str, warc.read_archives(spark, folder, manifest).collect()))
    plain = warc.read_archives(spark, folder2 := scratch(spark, "warc"), warc.write_archives(df, folder2, min_revisit=5)).collect()
    assert {r.record_type for r in plain} == {"response"}
    assert warc.read_archives(spark, folder, warc.write_archives(df.limit(0), folder)).count() == 0


def _archive(*payloads):
    return b"".join(warc.member(warc.record("response", i, "u", p, warc.base32_sha1(p), None)) for i, p in enumerate(payloads))


def test_broken_archives():
    good = _archive(b"one", b"two" * 1000)
    assert [r.payload for r in warc.read_records(io.BytesIO(good))] == [b"one", b"two" * 1000]
    with pytest.raises(warc.WarcError, match="inside a member"):
        list(warc.read_records(io.BytesIO(good[:-5])))
    raw = warc.record("response", 1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    for bad, message in ((raw.replace(b"\r\npayload", b"\r\npayl0ad"), "digest"), (raw[:-2], "does not end"), (raw.replace(b"WARC/1.1", b"XARC/1.1"), "version line")):
        with pytest.raises(warc.WarcError, match=message):
            list(warc.read_records(io.BytesIO(warc.member(bad))))


# -- shards -----------------------------------------------------------------------------------------


def test_every_table_is_merged(spark):
    """A query's small table too: fewer shards after the appends than before, and each row says whether its shard was merged."""
    for sf in ("sf0.001", "sf0.01"):
        docs = table(spark, f"/root/testdata/{sf}", "documents")
        out = compaction.shard(docs).collect()
        assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert {r.version for r in out} == {5} and len({r.shard for r in out}) < 4 and any(r.merged for r in out)
        assert len({(r.shard, r.shard_bytes, r.merged) for r in out}) == len({r.shard for r in out})


def test_one_of_two_writers_commits(spark):
    """Two writers at once, hundreds of times: each version is claimed by exactly one, and holds its name."""
    store = compaction.ShardStore(spark, scratch(spark, "shards"))

    def claim(name, version, gate):
        gate.wait()
        try:
            store._claim(version, name)
            return name
        except Py4JJavaError as e:
            assert "Exist" in e.java_exception.getClass().getName()
            return None

    with ThreadPoolExecutor(4) as pool:
        for version in range(1, 201):
            gate = threading.Barrier(4)
            won = [w for w in pool.map(lambda i: claim(f"w{i}", version, gate), range(4)) if w]  # noqa: B023
            assert len(won) == 1 and store._manifest_of(version) == won[0]
    assert store.version() == 200 and not [n for n in store._names("versions") if not n.isdigit()]


def test_two_appending_writers_lose_nothing(spark):
    root = scratch(spark, "shards")
    compaction.ShardStore(spark, root).append(spark.createDataFrame([(0,)], "doc_id long"))

    def write(who):
        own = compaction.ShardStore(spark, root)
        return [own.append(spark.createDataFrame([(1000 * who + i,)], "doc_id long")) for i in range(1, 9)]

    with ThreadPoolExecutor(2) as pool:
        versions = [v for own in pool.map(write, (1, 2)) for v in own]
    assert sorted(versions) == list(range(2, 18))
    assert sorted(r.doc_id for r in compaction.ShardStore(spark, root).read().collect()) == [0, *(1000 * w + i for w in (1, 2) for i in range(1, 9))]


def test_compaction(spark, monkeypatch):
    store = compaction.ShardStore(spark, scratch(spark, "shards"))
    rng = random.Random(4)
    rows = [(i if i % 50 else None, "".join(rng.choices("abcdef", k=rng.randrange(2000))) if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("group", F.lit("g")).withColumn("path", F.lit("p")).repartition(6)
    for i in range(3):
        store.append(df.filter(F.pmod(F.hash("text"), F.lit(3)) == i))
    everything = lambda v=None: sorted((tuple(r) for r in store.read(v).collect()), key=repr)
    before, version = everything(), store.version()
    assert version == 3 and before == sorted((tuple(r) for r in df.collect()), key=repr)
    target = 200_000
    assert store.compact(target, fan_in=2) == 4
    old, new = store.manifest(3), store.manifest(4)
    assert everything() == before == everything(3) and new.count() < old.count()
    assert new.agg(F.sum("n_rows")).first()[0] == len(rows) + 3 and max(r.bytes for r in new.collect()) < 2 * target
    assert store._commit(new, 3) is None and store.version() == 4  # another writer took that version
    assert everything() == before
    empty = store._path(f"{store.root}/versions/5")  # of a writer that died before it named its manifest
    store._fs.create(empty, False).close()
    assert store.version() == 4 and store._commit(new, 4) is None
    monkeypatch.setattr(compaction, "DEAD", -1)
    assert store._commit(new, 4) is None and not store._fs.exists(empty)
    data = len(store._names("data"))
    store.vacuum()
    assert everything() == before and len(store._names("data")) == data  # young folders stay
    store.vacuum(grace=-60)
    assert everything() == before and len(store._names("data")) < data and store._names("versions") == ["4"]
    with pytest.raises(ValueError, match="__path"):
        store.append(df.withColumn("__path", F.lit(1)))
    empty = compaction.ShardStore(spark, scratch(spark, "shards"))
    empty.append(df.limit(0))
    assert empty.read().count() == 0 and empty.compact() == empty.version()
    out = compaction.shard(df, target_bytes=target)
    assert out.count() == df.count() and out.columns == ["doc_id", "shard", "shard_bytes", "version", "merged"]


def test_writers_at_once(spark, monkeypatch):
    """A commit between another's look and its own loses neither's rows; a merge of what has gone starts over."""
    store = compaction.ShardStore(spark, scratch(spark, "shards"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text")).coalesce(1)
    for i in range(4):
        store.append(rows(i * 10, i * 10 + 10))
    commit, meddled = store._commit, []

    def late(live, base, other=None):
        if not meddled:
            meddled.append(1)
            compaction.ShardStore(spark, store.root).append(rows(100, 110)) if other is None else other()
        return commit(live, base)

    monkeypatch.setattr(store, "_commit", late)
    assert store.append(rows(200, 210)) == 6
    ids = lambda: sorted(r.doc_id for r in store.read().collect())
    assert ids() == [*range(40), *range(100, 110), *range(200, 210)]
    meddled.clear()
    assert store.compact(1 << 20, fan_in=2) == 8 and len(ids()) == 70  # an append came between
    meddled.clear()
    store.append(rows(300, 310))
    before = ids()
    monkeypatch.setattr(store, "_commit", lambda live, base: late(live, base, lambda: compaction.ShardStore(spark, store.root).compact(1 << 20, fan_in=2)))
    meddled.clear()
    store.compact(1 << 20, fan_in=2)
    assert ids() == before


@pytest.mark.parametrize("target, fan_in", [(1000, 2), (4000, 3), (10**9, 4)])
def test_groups_as_brute_force(spark, monkeypatch, target, fan_in):
    store = compaction.ShardStore(spark, scratch(spark, "shards"))
    rng = random.Random(target)
    sizes = [(f"p{i:03}", rng.randrange(1, 5000), 1, 0) for i in range(80)] + [("a", 64, 1, 0), ("b", 64, 1, 0)]
    sizes = [(p, b, n, int(np.floor(np.log(b) / np.log(4)))) for p, b, n, _ in sizes]
    monkeypatch.setattr(store, "manifest", lambda version=None: spark.createDataFrame(sizes, compaction.COLUMNS))
    expected = []
    for tier in sorted({t for *_, t in sizes}):
        before, groups = 0, {}
        for b, p in sorted((b, p) for p, b, _, t in sizes if t == tier and b < target):
            groups.setdefault(before // target, []).append(p)
            before += b
        expected += [sorted(g) for _, g in sorted(groups.items()) if len(g) >= fan_in]
    got = {}
    for r in store.plan(target, fan_in).collect():
        got.setdefault(r[compaction.GROUP], []).append(r.path)
    assert [sorted(got[i]) for i in range(len(got))] == expected


# -- chats ------------------------------------------------------------------------------------------


def conversations(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        turns = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randrange(1, 5)
        for t, role in enumerate(turns):
            size = {"system": 20, "user": 8, "assistant": 60}[role]
            text = " ".join(rng.choice("alpha beta gamma delta note".split()) for _ in range(rng.randrange(2, size)))
            text += "?" if role == "user" and rng.random() < 0.8 else "."
            out.append((c, t, role, text + ("\nand a second line" if rng.random() < 0.2 else "")))
    return out


CHATS = "conv_id long, turn long, role string, text string"


def test_chat_roles(spark):
    """Held-out conversations: whole recovery where all turns are marked, most of it where a quarter are not or oddly."""
    model = chat.train(spark.createDataFrame(conversations(300, 1), CHATS))
    held_out = conversations(100, 2)
    df = spark.createDataFrame(held_out, CHATS)
    got = chat.format_chats(df, model, blur=0).collect()
    in_order = lambda found: sorted(found, key=lambda r: (r.conv_id, r.segment, r.position))
    assert [(r.conv_id, r.role, r.rendered) for r in in_order(got)] == [(c, role, chat.render([(role, text)])) for c, _, role, text in held_out]
    for blurred in (chat.format_chats(df, model, blur=8), chat.format_chats(df)):
        lines = Counter((r.conv_id, r.role) for r in blurred.collect() for _ in range(r.n_lines))
        truth = Counter((c, role) for c, _, role, text in held_out for _ in text.split("\n"))
        assert (lines & truth).total() > 0.85 * truth.total()


def test_viterbi_as_all_paths(spark):
    model = chat.train(spark.createDataFrame(conversations(60, 5), CHATS), blur=4)
    rng = random.Random(6)
    pool = ["User: what?", "Assistant: it is", "alpha beta", "", "[system] be brief", "Participant: why?", "x" * 300]
    n = len(chat.STATES)
    for _ in range(25):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        seen = model._seen(lines)
        for before, last in ((None, None), (2, None), (None, 3), (1, 4)):
            score = lambda p: (model.start if before is None else model.step[before])[p[0]] + sum(seen[i][s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            paths = [p for p in itertools.product(range(n), repeat=len(lines)) if last is None or p[-1] == last]
            assert score(model.decode(lines, before, last)) == pytest.approx(max(map(score, paths)))


def test_states_are_carried_over_cuts(spark):
    """Cut anywhere, what is decoded in pieces is as probable as the whole's path."""
    model = chat.train(spark.createDataFrame(conversations(60, 5), CHATS), blur=4)
    rng = random.Random(9)
    pool = ["User: what?", "Assistant: it is", "alpha beta", "", "Participant: why?", "x" * 300]
    for _ in range(40):
        lines = [rng.choice(pool) for _ in range(40)]
        cuts = [0, *sorted(rng.sample(range(1, 40), 4)), 40]
        parts = [lines[a:b] for a, b in itertools.pairwise(cuts)]
        reaches = [model.reach(part, i == 0) for i, part in enumerate(parts)]
        last = chat.boundaries([r[0] for r in reaches])
        path = []
        for i, part in enumerate(parts):
            own = model.decode(part, last[i - 1] if i else None, last[i])
            assert not i or own[0] == reaches[i][1][last[i - 1], last[i]]
            path += own
        seen = model._seen(lines)
        score = lambda p: model.start[p[0]] + sum(seen[i][s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert score(path) == pytest.approx(score(model.decode(lines)))


@pytest.mark.parametrize("cut", [{"SEGMENT": 7}, {"SEGMENT_CHARS": 150}])
def test_long_conversations_are_decoded_whole(spark, monkeypatch, cut):
    """Cut anywhere, over partitions, with the state carried: as the whole transcript; pieces in order are its rendering."""
    rng = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2], ("is it so?", rng.choice(["it is so.", "so it is.\nand more of it"]))[t % 2]) for c in (1, 2, None) for t in range(60)]
    model = chat.train(spark.createDataFrame(conversations(60, 7), CHATS))
    for name, n in cut.items():
        monkeypatch.setattr(chat, name, n)
    df = spark.createDataFrame(rows, CHATS)
    got = chat.format_chats(df, model, blur=0).collect()
    assert max(r.segment for r in got) >= 5
    for c in (1, 2, None):
        transcript = "\n".join(chat.marked(role, text, chat._key(own, t)) for own, t, role, text in rows if own == c)
        whole = model.parse(transcript)
        pieces = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.segment, r.position))
        assert [r.role for r in pieces if not r.goes_on] == [role for role, _, _ in whole]
        assert sum(r.n_lines for r in pieces) == len(transcript.split("\n"))
        squeezed = lambda s: "".join(s.split())
        assert squeezed("".join(r.rendered for r in pieces)) == squeezed(chat.render([(role, text) for role, text, _ in whole]))


def test_chat_edges(spark):
    long = "word " * 300_000
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 1, "tool", "x: y"), (1, 0, "user", ""), (2, 5000, "assistant", "late"), (3, 1, "user", long)]
    df = spark.createDataFrame(rows, CHATS).withColumn("segment", F.lit("clash"))
    got = chat.format_chats(df, blur=0).collect()
    assert {r.conv_id for r in got} == {1, 2, 3} and [r.role for r in got if r.conv_id == 2] == ["assistant"]
    assert sum(r.n_lines for r in got if r.conv_id == 1) == 3  # equal rows are turns each
    assert [r.rendered for r in got if r.conv_id == 3] == [chat.render([("user", long.strip())])]
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.marker("### Human: hi")[0] == "user" and chat.marker("<|assistant|> hi")[0] == "assistant" and chat.marker("plain")[0] == "none"


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        path = scratch(spark, "stage")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[4][1](spark, kept, sf)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in kept.collect())
    bench = {r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = [r.text for r in kept.collect()]
    assert texts and not any(b in t for t in texts for b in bench)


def test_pipeline_with_odd_rows(spark):
    """Null and repeated ids, null and empty texts, equal rows, null sources and languages, columns of the names used inside; no rows at all."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    schema = docs.schema
    clean = docs.filter("lang = 'en'").first()
    odd = [(None, f"{clean.text} once more", "en", None, 5), (None, None, None, "s", 0), (7, "", "", "s", 0), (7, "two words", "xx", "s", 9), (None, None, None, "s", 0), (7, "two words", "xx", "s", 9)]
    by_name = {"doc_id": 0, "text": 1, "lang": 2, "source": 3, "n_chars": 4}
    rows = spark.createDataFrame([tuple(r[by_name[f.name]] for f in schema.fields) for r in odd], schema)
    more = docs.unionByName(rows).withColumn("label", F.lit("x")).withColumn("node", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("size", F.lit(3)).withColumn("shard", F.lit("y"))
    kept, none = more, more.limit(0)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept, none = stage(spark, kept, sf), stage(spark, none, sf)
        assert kept.columns == more.columns and none.columns == more.columns and none.count() == 0
        path = scratch(spark, "odd")
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        counts.append(kept.count())
    after_dedup = counts[1]
    assert counts[0] >= after_dedup > 0
    assert kept.filter("doc_id = 7 AND text = 'two words'").count() >= 1  # a language without a model, a text of its own
    last = corpus_pipeline.STAGES[4][1](spark, kept, sf)
    assert last.count() == kept.count() and corpus_pipeline.STAGES[4][1](spark, none, sf).count() == 0
