"""Operators against hand-worked assemblies and independent models."""

import itertools
import random

import pytest
from pyspark.sql import Window, functions as F

from contigua.operators.components import component_labels
from contigua.operators.lineage import Rounds
from contigua.operators import filters, graph, ingest, kmers, overlaps, paths, stats


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_split_at_gaps(spark):
    rec = spark.createDataFrame([("h1", "NNACGTNNNaCcnGTAXX")], "header string, sequence string")
    f = ingest.features(rec).cache()
    assert [r[2:5] for r in rows(f, "header", "i", "name", "kind", "text")] == [
        ("h1.1", "GAP", "NN"), ("h1.2", "SEGMENT", "ACGT"), ("h1.3", "GAP", "NNN"), ("h1.4", "SEGMENT", "aCc"), ("h1.5", "GAP", "n"), ("h1.6", "SEGMENT", "GTA"), ("h1.7", "GAP", "XX"),
    ]
    assert rows(ingest.gaps_of(f), "name", "s1", "s1_or", "s2", "s2_or") == [("h1.1", "h1.2", "+", "h1.2", "+"), ("h1.3", "h1.2", "+", "h1.4", "+"), ("h1.5", "h1.4", "+", "h1.6", "+"), ("h1.7", "h1.6", "+", "h1.6", "-")]
    masked = rec.select(ingest.soft_masked(F.col("sequence")).alias("a"), ingest.soft_masked(F.col("sequence"), compat=True).alias("b")).first()
    assert tuple(masked) == (2, 3)


def test_terminal_gaps_go_where_their_record_lies(spark):
    """Rows that know their record's ends give what the join and the window give; the query shuffles nothing."""
    from contigua.plans import catalog

    rng = random.Random(17)
    texts = ["", None, "N", "NNXx", "A", "NA", "AN", "NAN", "ANA", "NANAN", "nnAxxCNNGn", *("".join(rng.choice("ACNx") for _ in range(rng.randint(1, 12))) for _ in range(80))]
    f = ingest.features(spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "header string, sequence string")).cache()
    joined = paths.remove_terminal_gaps(ingest.components_of(f), ingest.gaps_of(f).select(F.col("name").alias("header"), "s1", "s2"))
    local = paths.remove_terminal_gaps(ingest.components_of(f, "last"), None, *ingest.terminal_gaps())
    assert rows(local, *joined.columns) == rows(joined) and local.count() < f.count()
    plan = catalog.queries()["remove_terminal_gaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_nstar(spark):
    contigs = spark.createDataFrame([(4,), (3,), (3,)], "len long")
    got = stats.nstar(contigs).orderBy("n").collect()
    assert [r.nx for r in got] == [4, 4, 4, 4, 3, 3, 3, 3, 3, 3] and [r.lx for r in got] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert stats.aun(contigs).first().aun == 3.4
    gaps = spark.createDataFrame([(2,), (3,), (1,), (2,)], "len long")
    got = stats.nstar(gaps).orderBy("n").collect()
    assert [r.nx for r in got] == [3, 3, 3, 2, 2, 2, 2, 2, 1, 1] and [r.lx for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    ng = stats.nstar(contigs, genome_size=40).orderBy("n").collect()
    assert [(r.nx, r.lx) for r in ng] == [(4, 1), (3, 3)] + [(0, 0)] * 8
    assert stats.nstar(contigs.filter("len > 9")).agg(F.sum("nx"), F.count("n")).first()[:] == (0, 10)


def _graph(spark, turned=False):
    o = "-" if turned else "+"
    edges = spark.createDataFrame([("a", "+", "b", "+"), ("a", "+", "c", o), ("b", "+", "d", "+"), ("c", o, "d", "+")], "s1 string, s1_or string, s2 string, s2_or string")
    nodes = spark.createDataFrame([("a", 5), ("b", 2), ("c", 2), ("d", 4), ("e", 7)], "node string, len long")
    return nodes, edges


def test_graph(spark):
    nodes, edges = _graph(spark)
    got = {r.metric: r.value for r in graph.graph_summary(nodes, edges).collect()}
    assert got == {"# edges": 4, "Average degree": 0.8, "# connected components": 1, "Largest connected component length": 13, "# dead ends": 4, "# disconnected components": 1, "Total length disconnected components": 7, "# separated components": 2}
    adj = graph.adjacency(edges)
    assert rows(graph.bubbles(adj, compat=True)) == []
    assert rows(graph.bubbles(adj)) == [("b", "a", "d", "c"), ("c", "a", "d", "b")]
    assert rows(graph.node_report(nodes, adj), "node", "dead_ends") == [("a", 1), ("b", 0), ("c", 0), ("d", 1), ("e", 2)]
    assert len(rows(graph.bubbles(graph.adjacency(_graph(spark, True)[1])))) == 2
    assert graph.adjacency(edges.union(edges.selectExpr("s2", "translate(s2_or, '+-', '-+')", "s1", "translate(s1_or, '+-', '-+')"))).count() == 8
    d = graph.shortest_distances(adj, spark.createDataFrame([("a",)], "node string"))
    assert rows(d) == [("a", 0.0), ("b", 1.0), ("c", 1.0), ("d", 2.0)]


@pytest.mark.parametrize("compat", [True, False])
def test_bubbles_read_their_records_three_times(spark, compat):
    """Random graphs with loops and double edges against a search from every probe; probes and their first steps are made once, and grouped by hash."""
    rng, turn, expected = random.Random(31), {"+": "-", "-": "+"}, set()
    edges = []
    for g in range(150):
        ids = [g * 10 + i for i in range(rng.choice([2, 3, 4, 5]))]
        edges += [(rng.choice(ids), rng.choice("+-"), rng.choice(ids), rng.choice("+-")) for _ in range(rng.randint(2, 7))]
    met = {}
    for a, x, b, y in {min((a, x, b, y), (b, turn[y], a, turn[x])) for a, x, b, y in edges}:
        met.setdefault(a, []).append((x, b, y))
        met.setdefault(b, []).append((turn[y], a, turn[x]))
    ways = lambda node, end: {o for x, o, y in met[node] if (y if compat else turn[x]) == end}
    for b0, own in met.items():
        if len(own) != 2 or {x for x, *_ in own} != {"+", "-"}:
            continue
        (_, b2, r1), (_, b1, l1) = sorted(own)
        if min(len(met[b1]), len(met[b2])) >= 2:
            there = ways(b1, l1) - {b0}
            expected |= {(b0, b1, b2, None if to == b2 else to) for to in there if to == b2 or to in ways(b2, r1)}
    found = graph.bubbles(graph.adjacency(spark.createDataFrame(edges, "s1 long, s1_or string, s2 long, s2_or string")), compat)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected) and any(e[3] is None for e in expected) and any(e[3] for e in expected)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 3 and "SortAggregate" not in plan


def test_components_of_a_long_path(spark):
    """Ids in random order: rounds grow with the logarithm, and the bound on what one task unites changes nothing."""
    ids = list(range(20_001))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    for small in (0, 1000, 1_000_000):
        labels, rounds = component_labels(edges, small)
        assert labels.agg(F.count("node"), F.max("label")).first()[:] == (20_001, 0)
        assert rounds <= 20


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(0, rng.randrange(900)) for _ in range(50)] + [(950, 950), (951, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs[:-1]:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for small in (0, 50, 1_000_000):
        got = component_labels(spark.createDataFrame(pairs, "a long, b long"), small)[0].collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up)
    none = component_labels(spark.createDataFrame([], "a string, b string"))[0]
    assert none.dtypes == [("node", "string"), ("label", "string")] and none.collect() == []


def test_discover_paths(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    gaps = spark.createDataFrame([("a", "b"), ("b", "c")], "s1 string, s2 string")
    assert rows(graph.discover_paths(nodes, gaps), "path", "ord", "comp") == [("a_path", 1, "a"), ("a_path", 2, "b"), ("a_path", 3, "c"), ("d_path", 1, "d")]


def test_shortest_distances_over_chains(spark, monkeypatch):
    """Chains, rings and branches, weighted, against relaxing one by one; a chain of thousands of nodes takes few rounds."""
    rng = random.Random(12)
    links = [(i, i + 1, rng.randint(1, 9)) for i in range(60)] + [(100 + i, 100 + (i + 1) % 7, 2) for i in range(7)] + [(200 + i, 200 + (i + 1) % 5, 3) for i in range(5)]
    links += [(20, 100, 4), (20, 300, 1), (300, 40, 2), (7, 7, 1), (7, 8, 50)] + [(rng.randint(400, 430), rng.randint(400, 430), rng.randint(1, 5)) for _ in range(40)] + [(55, 400, 1)]
    both = links + [(b, a, w) for a, b, w in links]
    for start in ([0], [10, 104], [300, 415], [999]):
        best = {s: 0 for s in start}
        for _ in range(200):
            for a, b, w in both:
                if a in best and best[a] + w < best.get(b, 1 << 60):
                    best[b] = best[a] + w
        got = graph.shortest_distances(spark.createDataFrame(both, "node long, other long, w long"), spark.createDataFrame([(s,) for s in start], "node long"), "w", previous=True).collect()
        assert {r.node: r.dist for r in got} == best
        weights = {}
        for a, b, w in both:
            weights[a, b] = min(w, weights.get((a, b), w))
        for r in got:
            assert (r.previous is None) == (r.node in start) and (r.previous is None or best[r.previous] + weights[r.previous, r.node] == best[r.node])
    n, tables = 20_000, []
    write = Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: tables.append(1) or write(self, df))
    chain = spark.range(n - 1).selectExpr("id * 7919 % 20011 AS node", "(id + 1) * 7919 % 20011 AS other")
    far = graph.shortest_distances(chain.union(chain.select("other", "node")), spark.createDataFrame([(0,)], "node long"))
    assert far.agg(F.count("node"), F.sum("dist"), F.max("dist")).first()[:] == (n, n * (n - 1) / 2, n - 1)
    assert len(tables) <= 2 * 30


@pytest.mark.parametrize("limit", [90, 1 << 20])
def test_shortest_distances_in_blocks(spark, monkeypatch, limit):
    """A weighted grid with one-way links, a hub and a part out of reach, cut into blocks and as one, against relaxing one by one."""
    rng, side = random.Random(limit), 10
    name = lambda x, y: f"n{x}_{y}"
    links = {}
    for x, y in itertools.product(range(side), range(side)):
        for dx, dy in ((1, 0), (0, 1)):
            if x + dx < side and y + dy < side:
                links[name(x, y), name(x + dx, y + dy)] = rng.randint(0, 9)
                if rng.random() < 0.8:
                    links[name(x + dx, y + dy), name(x, y)] = rng.randint(1, 9)
    links |= {("hub", name(x, x)): 40 + x for x in range(side)} | {(name(3, 3), "hub"): 2, ("far", "away"): 1, ("away", "far"): 1, ("hub", "hub"): 0}
    sources = [name(0, 0), name(5, 9), "alone"]
    best, moved = {s: 0 for s in sources}, True
    while moved:
        moved = False
        for (a, b), w in links.items():
            if a in best and best[a] + w < best.get(b, 1 << 60):
                best[b], moved = best[a] + w, True
    tables, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: tables.append(1) or write(self, df))
    table = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "node string, other string, w long")
    got = graph.shortest_distances(table, spark.createDataFrame([(s,) for s in sources], "node string"), "w", limit=limit).collect()
    assert len(got) == len(best) and {r.node: r.dist for r in got} == best and "far" not in best
    if limit > len(links):
        assert len(tables) < 20  # chains, and one round
    assert graph.shortest_distances(table, spark.createDataFrame([], "node string"), "w", limit=limit).count() == 0


def test_shortest_distances_of_odd_sources(spark):
    adj = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (None, 3), (4, None)], "node long, other long")
    of = lambda table, *nodes: rows(graph.shortest_distances(table, spark.createDataFrame([(n,) for n in nodes], "node long")))
    assert of(adj, 1, None) == [(1, 0), (2, 1), (3, 2), (4, 2)]
    assert of(adj, None) == [] and of(adj.limit(0), 7) == [(7, 0)]


def walk_plainly(nodes, gaps):
    """Steps and gaps left over, one gap after the other; gaps are (header, s1, o1, s2, o2, dist)."""
    at, over = {}, {}
    for g, s1, o1, s2, o2, dist in gaps:
        if s1 == s2:
            over[g] = "terminal"
        else:
            for side in ((s1, "L" if o1 == "-" else "R"), (s2, "R" if o2 == "-" else "L")):
                at.setdefault(side, []).append((dist, g))
    best = {side: min(own)[1] for side, own in at.items()}
    ends = {}
    for g, s1, o1, s2, o2, _ in gaps:
        if s1 != s2:
            x, y = (s1, "L" if o1 == "-" else "R"), (s2, "R" if o2 == "-" else "L")
            if best[x] == g == best[y]:
                ends[x], ends[y] = (y, g), (x, g)
            else:
                over[g] = "branch"
    steps, left = [], set(nodes)

    def walk(node, side):
        """From a segment entered by a side."""
        out = []
        while True:
            leave = "R" if side == "L" else "L"
            to, gap = ends.get((node, leave), (None, None))
            out.append([node, "+" if side == "L" else "-", gap])
            if to is None or to[0] == out[0][0]:
                return out
            node, side = to

    def take(own):
        first = own[0][0]
        steps.extend((f"{first}_path", i, n, o, g) for i, (n, o, g) in enumerate(own, 1))
        left.difference_update(n for n, _, _ in own)

    heads = sorted((side == "R", n) for n in nodes for side in "LR" if (n, side) not in ends and ((n, "L") in ends or (n, "R") in ends))
    for turned, n in heads:
        if n in left:
            own = walk(n, "R" if turned else "L")
            mirror = (own[-1][1] == "+", own[-1][0])
            if (turned, n) < mirror:
                take(own)
    for n in sorted(left):
        if n in left and (n, "L") not in ends and (n, "R") not in ends:
            take([[n, "+", None]])
    for n in sorted(left):
        if n in left:
            own = walk(n, "L")
            over[own[-1][2]] = "ring"
            own[-1][2] = None
            take(own)
    return sorted(steps), sorted(over.items())


def test_gap_walks(spark):
    """Branches, turned segments, rings and terminal gaps, against walking one by one; no gap is lost."""
    rng = random.Random(8)
    chain = [f"c{i:03}" for i in rng.sample(range(200), 120)]
    signs = [rng.choice("+-") for _ in chain]
    gaps = [(f"l{i}", chain[i], signs[i], chain[i + 1], signs[i + 1], 3) if rng.random() < 0.5 else (f"l{i}", chain[i + 1], "+-"[signs[i + 1] == "+"], chain[i], "+-"[signs[i] == "+"], 3) for i in range(len(chain) - 1)]
    ring = [f"r{i}" for i in (5, 2, 8, 1, 9)]
    gaps += [(f"o{i}", ring[i], "+" if i % 2 else "-", ring[(i + 1) % 5], "+" if (i + 1) % 5 % 2 else "-", i) for i in range(5)]
    nodes = sorted({*chain, *ring, "c000", "alone", "x", "y", "z"})
    gaps += [("t1", "x", "+", "x", "+", 7), ("t2", "y", "+", "y", "-", 9), ("b1", "x", "+", "y", "+", 4), ("b2", "x", "+", "z", "+", 4), ("b3", "z", "-", "c000", "-", 1)]
    few = [f"n{i}" for i in range(30)]
    gaps += [(f"q{i}", rng.choice(few), rng.choice("+-"), rng.choice(few), rng.choice("+-"), rng.randint(1, 5)) for i in range(60)]
    nodes += few
    df = spark.createDataFrame(gaps, "header string, s1 string, s1_or string, s2 string, s2_or string, dist long")
    steps, over = graph.gap_walks(spark.createDataFrame([(n,) for n in nodes], "node string"), df)
    got, lost = sorted(map(tuple, steps.collect())), sorted(map(tuple, over.collect()))
    want = walk_plainly(nodes, gaps)
    assert got == want[0] and lost == want[1]
    assert sorted(n for _, _, n, _, _ in got) == sorted(nodes)
    assert sorted([g for *_, g in got if g] + [g for g, _ in lost]) == sorted(g[0] for g in gaps)
    sizes = spark.createDataFrame([(n, 10, 4, 3, 2, 1, 0) for n in nodes], "node string, len long, a long, c long, g long, t long, lower long")
    walked = {r.path: r for r in graph.scaffold_walk(sizes, df).collect()}
    own = walked["x_path"]
    assert (own.n, own.size, own.a, own.t) == (2, 10 + 7 + 4 + 10 + 9, 8, 2)
    dist = {g[0]: g[5] for g in gaps}
    for path, r in walked.items():
        mine = [s for s in got if s[0] == path]
        if path != "x_path":
            assert r.n == len(mine) and r.a == sum(4 if o == "+" else 1 for *_, o, _ in mine)
            assert r.size >= sum(10 + dist.get(g, 0) for *_, g in mine)


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_gap_walks_in_fragments(spark, batch):
    """Walks and rings that lie in several batches of links are those of walking one by one; what meets between tasks follows the cuts."""
    rng = random.Random(batch)
    gaps, nodes = [], []
    for kind in range(12):  # chains and rings of either kind of order, some across the batches
        n = rng.randint(2, 60)
        own = [f"{'abcdef'[kind % 6]}{kind:02}{i:03}" for i in rng.sample(range(n), n)]
        signs = [rng.choice("+-") for _ in own]
        nodes += own
        for i in range(n if kind % 3 == 0 and n > 2 else n - 1):
            k = (i + 1) % n
            one, two = (own[i], signs[i]), (own[k], signs[k])
            flip = {"+": "-", "-": "+"}
            gaps.append((f"g{kind}_{i}", *one, *two, i) if rng.random() < 0.5 else (f"g{kind}_{i}", two[0], flip[two[1]], one[0], flip[one[1]], i))
    few = [f"n{i}" for i in range(40)]
    gaps += [(f"q{i}", rng.choice(few), rng.choice("+-"), rng.choice(few), rng.choice("+-"), rng.randint(1, 5)) for i in range(70)]
    nodes += [*few, "alone"]
    df = spark.createDataFrame(gaps, "header string, s1 string, s1_or string, s2 string, s2_or string, dist long").coalesce(2)
    steps, over = graph.gap_walks(spark.createDataFrame([(n,) for n in nodes], "node string"), df, batch)
    want = walk_plainly(sorted(nodes), gaps)
    assert sorted(map(tuple, steps.collect())) == want[0] and sorted(map(tuple, over.collect())) == want[1]


def test_fragments_follow_cuts(spark):
    """A chain of 20,000 links in order is one fragment a batch, not a state a node."""
    from contigua.operators.fragments import fragments

    links = spark.range(0, 20_000, 1, 2).selectExpr("concat('g', id) gap", "1L dist", "id a", "'R' aside", "id + 1 b", "'L' bside")
    rows = fragments(links, 1000)
    assert rows.filter("p = 0").count() == 20 and rows.filter("p < k").select("gap").distinct().count() == 20_000


def test_kmers(spark):
    read = lambda s: spark.createDataFrame([("r", s)], "header string, sequence string")
    db = kmers.count_kmers(read("ACGTA"), 3)
    assert rows(db) == [("ACG", 2), ("GTA", 1)]
    assert tuple(kmers.db_stats(kmers.histogram(db), 3).first()) == (3, 2, 1, 62)
    assert kmers.count_kmers(read("ACNGT"), 3).count() == 0
    assert rows(kmers.union(db, db)) == [("ACG", 4), ("GTA", 2)]
    long = "".join(random.Random(2).choice("ACGT") for _ in range(25_000))  # crosses chunks
    assert kmers.windows(read(long), 21).count() == len(long) - 20
    alternatives = spark.range(1).select(kmers.walk_alternatives(F.array(F.array(F.lit('A'), F.lit('C')), F.array(F.lit('G')), F.array(F.lit('T'), F.lit('')))).alias('x'))
    assert alternatives.first().x == ['AGT', 'AG', 'CGT', 'CG']


def test_terminal_overlaps(spark):
    rng = random.Random(3)
    comp = str.maketrans("ACGT", "TGCA")
    core = "".join(rng.choice("ACGT") for _ in range(400))
    segs = {"a": core[:150], "b": core[120:260], "c": core[240:][::-1].translate(comp), "d": "ACGT" * 20}
    least = 12
    expected = set()
    for (n1, s1), (n2, s2) in itertools.product(segs.items(), repeat=2):
        for o1, o2 in (("+", "+"), ("+", "-"), ("-", "+")):
            x, y = (s if o == "+" else s[::-1].translate(comp) for s, o in ((s1, o1), (s2, o2)))
            best = max((n for n in range(least, min(len(x), len(y)) + 1) if x[-n:] == y[:n] and not (n1 == n2 and o1 == o2 and n == len(y))), default=0)
            if n1 <= n2 and best:
                expected.add((n1, o1, n2, o2, best))
    table = spark.createDataFrame(list(segs.items()), "header string, sequence string")
    assert set(rows(overlaps.terminal_overlaps(table, least))) == expected and expected
    assert set(rows(overlaps.terminal_overlaps(table, least, bits=64))) == expected  # a full table lets all through


@pytest.mark.parametrize("bits", [overlaps.BITS, 64])
def test_longest_overlaps(spark, bits):
    rng = random.Random(4)
    comp = str.maketrans("ACGT", "TGCA")
    shared = "".join(rng.choice("ACGT") for _ in range(40))
    segs = {f"s{i}": shared[rng.choice((0, 0, 3)) : rng.randint(9, 40)] + "".join(rng.choice("AC") for _ in range(rng.randint(0, 9))) + shared[: rng.randint(6, 40)] for i in range(30)}
    segs |= {"copy1": shared, "copy2": shared, "runs": "A" * 50, "short": "ACG", "empty": "", "lower": shared.lower()[:20]}
    least, window = 6, 45
    turned = {(n, o): s.upper() if o == "+" else s.upper()[::-1].translate(comp) for n, s in segs.items() for o in "+-" if len(s) >= least}
    expected = set()
    for (n1, o1), x in turned.items():
        tail, found = x[-window:], {}
        for (n2, o2), y in turned.items():
            for n in range(least, min(len(tail), len(y[:window])) + 1):
                if tail[-n:] == y[:n] and not ((n1, o1) == (n2, o2) and n == len(y)):
                    found.setdefault(n, []).append(n2)
        if found:
            expected.add((n1, o1, max(found), len(found[max(found)])))
    table = spark.createDataFrame([*segs.items(), ("none", None)], "header string, sequence string")
    assert set(rows(overlaps.longest_overlaps(table, least, window, bits))) == expected and len(expected) > 30
    assert overlaps.longest_overlaps(table.limit(0), least).count() == 0


def test_overlaps_of_a_frequent_end(spark):
    """20,000 segments begin and end with one text: 4e8 pairs, but a row an end and orientation."""
    shared = "ACGGTCATTGCAGGCTTAACCGATTGGCATC"
    middle = F.regexp_replace(F.sha2(F.col("id").cast("string"), 256), "[^acd]", "T")
    table = spark.range(20_000).select(F.col("id").cast("string").alias("header"), F.concat(F.lit(shared), F.upper(F.translate(middle, "d", "G")), F.lit(shared)).alias("sequence"))
    sets = overlaps.overlap_sets(table, 31)
    assert rows(sets.groupBy("side", "n").count()) == [(s, n, 40_000) for s in ("head", "tail") for n in (31, 126)]  # 126: with itself
    assert rows(overlaps.longest_overlaps(table, 31).groupBy("orientation", "overlap", "partners").count()) == [("+", 31, 20_000, 20_000), ("-", 31, 20_000, 20_000)]


def test_trim(spark):
    comps = spark.createDataFrame([("p", 1, "SEGMENT", "a", "+", 0, 0, 5), ("p", 2, "GAP", "g", "0", 0, 0, 2), ("p", 3, "SEGMENT", "b", "+", 0, 0, 4)], "path string, ord long, ctype string, comp string, orientation string, start long, end long, len long")
    got = paths.trim(comps, F.lit(4), F.lit(9))
    assert rows(got, "ord", "comp", "start", "end", "len") == [(1, "a", 4, 5, 2), (2, "g", 0, 0, 2), (3, "b", 1, 2, 2)]
    back = paths.trim(paths.revcom(comps), F.lit(1), F.lit(3))
    assert rows(back, "comp", "orientation", "start", "end") == [("b", "-", 2, 4)]
    total = comps.withColumn("t", F.sum("len").over(Window.partitionBy("path")))
    for lo, hi in ((1, 11), (2, 6), (6, 7), (5, 11)):
        assert paths.trim(total, F.lit(lo), F.lit(hi)).agg(F.sum("len")).first()[0] == hi - lo + 1


def test_filters(spark):
    rec = spark.createDataFrame([("a", "0123456789"), ("b", "0123456789"), ("c", "01234")], "header string, sequence string")
    bed = spark.createDataFrame([("a", 4, 6), ("a", 1, 3), ("a", 2, 5), ("b", 0, 0)], "chrom string, start long, end long")
    assert rows(filters.include(rec, bed)) == [("a", "12345"), ("b", "0123456789")]
    assert rows(filters.exclude(rec, bed)) == [("a", "06789"), ("c", "01234")]
    assert rows(filters.neither(rec, bed, bed.filter("chrom = 'b'"))) == [("c", "01234")]


def test_overlap_seeds_let_few_places_through(spark):
    """A table of 16 bits a seed: the places that no seed stands at are spared but for some in a thousand."""
    import random

    dice = random.Random(5)
    table = spark.createDataFrame([(str(i), "".join(dice.choices("ACGT", k=300))) for i in range(2000)], "header string, sequence string")
    found = overlaps._candidates(overlaps._oriented(table, 31, 20_000), 31, 1 << 16).count()
    places = 2 * 2 * 2000 * 270
    assert 2 * 2 * 2000 <= found < places // 100  # whole texts are always offered


def test_overlaps_of_copies(spark):
    """Copies are named in the result, each pair once, and a copy is no partner of itself."""
    unit, end = "ACGTTGCATGGA" * 4, "T" * 5
    table = spark.createDataFrame([(f"c{i}", unit) for i in range(4)] + [("x", unit + end)], "header string, sequence string")
    got = {(r.s1, r.s2): r.overlap for r in overlaps.terminal_overlaps(table, 31).filter("s1_or = '+' AND s2_or = '+'").collect()}
    expected = {(f"c{i}", f"c{j}"): 48 for i in range(4) for j in range(i + 1, 4)} | {(f"c{i}", f"c{i}"): 36 for i in range(4)} | {(f"c{i}", "x"): 48 for i in range(4)}
    assert got == expected
    best = {(r.header, r.orientation): (r.overlap, r.partners) for r in overlaps.longest_overlaps(table, 31).collect()}
    assert best["c0", "+"] == (48, 4) and best["c3", "-"] == (48, 3)


def _long_overlap(spark):
    dice = random.Random(6)
    shared = "".join(dice.choices("ACGT", k=25_000))
    return spark.createDataFrame([("a", "".join(dice.choices("ACGT", k=700)) + shared), ("b", shared + "".join(dice.choices("ACGT", k=900)))], "header string, sequence string")


def test_longest_overlaps_reach_beyond_20_000_bases(spark):
    assert set(rows(overlaps.longest_overlaps(_long_overlap(spark), 31))) == {("a", "+", 25_000, 1), ("b", "-", 25_000, 1)}


def test_long_texts_are_hashed_in_pieces(spark):
    """A text longer than what is hashed at once offers the same rows."""
    oriented = overlaps._oriented(_long_overlap(spark), 31, None)
    assert rows(overlaps._candidates(oriented, 31, 1 << 16, 999)) == rows(overlaps._candidates(oriented, 31, 1 << 16))


def test_terminal_overlaps_reach_beyond_20_000_bases(spark):
    assert rows(overlaps.terminal_overlaps(_long_overlap(spark), 31)) == [("a", "+", "b", "+", 25_000)]


@pytest.mark.parametrize("block", [1000, 3])
def test_ends_of_repeats_are_paired_once(spark, block):
    """Repeats of one unit overlap by many lengths; pairs are made in blocks, each once, and none is shuffled or joined by text."""
    unit = "ACGTTGCATGGATTC"
    comp = str.maketrans("ACGT", "TGCA")
    segs = {f"r{i}": "GA" * (i % 3) + unit * (4 + i % 5) + unit[: i % 4] for i in range(12)} | {"turned": (unit * 6)[::-1].translate(comp), "own": "ACGT" * 10}
    segs["alone"] = (end := "CCATGTTTGACCGGAGTATCAACTGTGGCACTT") + "GGTACC" + end
    expected = set()
    for (n1, s1), (n2, s2) in itertools.product(segs.items(), repeat=2):
        for o1, o2 in (("+", "+"), ("+", "-"), ("-", "+")):
            x, y = (s if o == "+" else s[::-1].translate(comp) for s, o in ((s1, o1), (s2, o2)))
            best = max((n for n in range(31, min(len(x), len(y)) + 1) if x[-n:] == y[:n] and not (n1 == n2 and o1 == o2 and n == len(y))), default=0)
            if n1 <= n2 and best:
                expected.add((n1, o1, n2, o2, best))
    found = overlaps.terminal_overlaps(spark.createDataFrame(list(segs.items()), "header string, sequence string"), 31, block=block)
    assert rows(found) == sorted(expected) and len(expected) > 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and "Join" not in plan.split("MapInArrow")[0]


def test_orders_are_sorted_once_to_be_trimmed(spark):
    from contigua.plans import catalog

    plan = catalog.queries()["path_trim"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [path#") == 1


def test_masked_path_is_placed_once(spark):
    """MASK reads what stands on its path from a table of its own, and all other components once."""
    from contigua.plans import catalog

    plan = catalog.queries()["verb_mask"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate#") <= 2 and plan.count("lead(l_partkey") == 1


def test_rounds_of_shortest_ways_send_no_tables_to_the_driver(spark, monkeypatch):
    """Their joins are shuffles however small the tables are; the session's own setting is back afterwards."""
    from contigua.operators.lineage import Rounds

    key, seen, write = "spark.sql.autoBroadcastJoinThreshold", [], Rounds.write
    before = spark.conf.get(key)
    monkeypatch.setattr(Rounds, "write", lambda self, df: seen.append(spark.conf.get(key)) or write(self, df))
    adj = graph.adjacency(spark.createDataFrame([(i, "+", i + 1, "+") for i in range(5)], "s1 long, s1_or string, s2 long, s2_or string"))
    got = graph.shortest_distances(adj, spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, got.collect())) == [(i, float(i)) for i in range(6)]
    assert seen.count("-1") == len(seen) - 2 and spark.conf.get(key) == before  # the links and the sources join nothing
