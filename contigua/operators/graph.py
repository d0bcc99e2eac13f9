"""Bidirected assembly graphs: adjacency, degrees, components, bubbles, circles, subgraphs, gap chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contigua.operators.blocks import LIMIT, distances
from contigua.operators.components import component_labels
from contigua.operators.fragments import LINKS, fragments
from contigua.operators.lineage import Rounds, without_broadcasts


def flip(o: Column) -> Column:
    return F.translate(o, "+-", "-+")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, o0, other, o1): two records an edge, one at either end. An edge and its reverse-complement
    twin are the same edge."""
    fw = F.struct(F.col("s1").alias("a"), F.col("s1_or").alias("b"), F.col("s2").alias("c"), F.col("s2_or").alias("d"))
    rv = F.struct(F.col("s2").alias("a"), flip(F.col("s2_or")).alias("b"), F.col("s1").alias("c"), flip(F.col("s1_or")).alias("d"))
    one = edges.select(F.least(fw, rv).alias("k")).distinct()
    there = one.select(F.col("k.a").alias("node"), F.col("k.b").alias("o0"), F.col("k.c").alias("other"), F.col("k.d").alias("o1"))
    back = one.select(F.col("k.c").alias("node"), flip(F.col("k.d")).alias("o0"), F.col("k.a").alias("other"), flip(F.col("k.b")).alias("o1"))
    return there.unionAll(back)


def _sides_met() -> Column:
    """How many of a node's two sides have an edge, without a distinct count."""
    least, most = F.min("o0"), F.max("o0")
    return F.when(least.isNull(), 0).when(least == most, 1).otherwise(2).cast("long")


def node_report(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(node, degree, sides, dead_ends): no edge has two dead ends, edges on one side only have one."""
    own = adj.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), _sides_met().alias("sides"))
    joined = nodes.select("node").join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("sides", F.lit(0)).alias("sides"))
    return joined.withColumn("dead_ends", F.lit(2) - F.col("sides"))


def connected_components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, isolated nodes included."""
    labels, _ = component_labels(adj.select(F.col("node").alias("a"), F.col("other").alias("b")))
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def bubbles(adj: DataFrame, compat: bool = False) -> DataFrame:
    """(b0, b1, b2, b3): probe, its neighbours on the left and the right, and the node that closes the
    bubble; null where the neighbours meet directly.

    compat: neighbours are left by records whose far orientation equals that of the probe's record, which
    finds only bubbles with a branch on the other strand; else by the end that the probe does not touch.

    The records are used three times; they are written once to the shared folder. Records come in twos, so neighbours of a probe that go
    on to another node have two at least and need not be counted.
    """
    adj = Rounds(adj.sparkSession).write(adj)
    left, right = F.col("o0") == "-", F.col("o0") == "+"
    minus = F.col("o1") == "-"  # truth values and nodes, not structs: long nodes are then grouped by hash
    side = adj.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(left, 1)).alias("n_left"), F.count(F.when(right, 1)).alias("n_right"),
        F.max(F.when(left, F.col("other"))).alias("b1"), F.max(F.when(left, minus)).alias("l1"), F.max(F.when(right, F.col("other"))).alias("b2"), F.max(F.when(right, minus)).alias("r1"),
    )
    probes = side.filter("n = 2 AND n_left = 1 AND n_right = 1").select(F.col("node").alias("b0"), "b1", "l1", "b2", "r1")
    steps = adj.select(F.col("node").alias("at"), (minus if compat else right).alias("key"), F.col("other").alias("to"))
    first = probes.join(steps, (F.col("b1") == F.col("at")) & (F.col("l1") == F.col("key"))).filter("to <> b0").select("b0", "b1", "b2", "r1", "to")
    second = steps.toDF("at2", "key2", "to2")
    met = first.join(second, (F.col("b2") == F.col("at2")) & (F.col("r1") == F.col("key2")) & (F.col("to") == F.col("to2")), "left").filter("to = b2 OR to2 IS NOT NULL")
    return met.select("b0", "b1", "b2", F.when(F.col("to") != F.col("b2"), F.col("to")).alias("b3")).distinct()


def circular_segments(edges: DataFrame) -> DataFrame:
    return edges.filter("s1 = s2").select(F.col("s1").alias("node")).distinct()


def circular_paths(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths that begin and end with the same circular segment."""
    ends = components.groupBy("path").agg(F.min_by("comp", "ord").alias("first"), F.max_by("comp", "ord").alias("last")).filter("first = last")
    return ends.join(circular_segments(edges), F.col("first") == F.col("node"), "left_semi").select("path")


def subgraph(segments: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of the list ``keep`` (node) and the edges with both ends in it."""
    wanted = keep.select(F.col("node").alias("__keep"))
    inside = edges.join(wanted, F.col("s1") == F.col("__keep"), "left_semi").join(wanted, F.col("s2") == F.col("__keep"), "left_semi")
    return segments.join(wanted, F.col("header") == F.col("__keep"), "left_semi"), inside


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value); ``nodes`` has node and len."""
    from contigua.operators.stats import metric_rows

    adj = adjacency(edges)
    report = node_report(nodes, adj).join(nodes.select("node", "len"), "node")
    per_node = report.agg(F.coalesce(F.sum("dead_ends"), F.lit(0)).alias("dead"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("lone"), F.sum(F.when(F.col("degree") == 0, F.col("len")).otherwise(0)).alias("lone_len"), F.count(F.lit(1)).alias("n"))
    labels = connected_components(nodes, adj).join(nodes.select("node", "len"), "node")
    comps = labels.groupBy("label").agg(F.sum("len").alias("len")).agg(F.count(F.lit(1)).alias("separated"), F.max("len").alias("largest"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("edges"))
    row = per_node.join(F.broadcast(comps)).join(F.broadcast(n_edges))  # one row each
    row = row.withColumn("connected", F.col("separated") - F.col("lone")).withColumn("degree", F.round(F.try_divide(F.col("edges"), F.col("n")), 2))
    return metric_rows(row, {
        "edges": "# edges", "degree": "Average degree", "connected": "# connected components", "largest": "Largest connected component length", "dead": "# dead ends",
        "lone": "# disconnected components", "lone_len": "Total length disconnected components", "separated": "# separated components",
    })


def gap_adjacency(gaps: DataFrame) -> DataFrame:
    """(node, way, other, dist): gaps seen forward from the first segment and backward from the second."""
    fw = gaps.select(F.col("s1").alias("node"), F.lit("FW").alias("way"), F.col("s2").alias("other"), "dist")
    return fw.unionAll(gaps.select(F.col("s2").alias("node"), F.lit("BW").alias("way"), F.col("s1").alias("other"), "dist"))


def _ends(gaps: DataFrame) -> DataFrame:
    """(gap, dist, a, aside, b, bside): a gap's segments and the sides that it touches. A segment's sides are L, where its bases begin, and R; a
    gap leaves its first segment by R if that is +, and enters its second by L if that is +."""
    out, into = F.when(F.col("s1_or") == "-", "L").otherwise("R"), F.when(F.col("s2_or") == "-", "R").otherwise("L")
    return gaps.select(F.col("header").alias("gap"), "dist", F.col("s1").alias("a"), out.alias("aside"), F.col("s2").alias("b"), into.alias("bside"))


def _links(ends: DataFrame, store: Rounds) -> tuple[DataFrame, DataFrame | None]:
    """(gaps that may be walked, the others): of several gaps at a side the one of least distance, then least name, if it is that at its other side too.

    Sides with one gap, found by counting hashes, need no comparison and no shuffle of their gaps.
    """
    port = lambda node, side: F.xxhash64(node, side)
    met = ends.select(F.explode(F.array(port("a", "aside"), port("b", "bside"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    busy = store.write(met.filter("n > 1").select("h"))
    some = busy.count()
    if not some:
        return ends, None
    if some > 1 << 18:  # too many to tell each task of them
        sure, rest = None, ends
    else:
        known = lambda name: F.broadcast(busy.select(F.col("h").alias(name)))
        told = ends.join(known("ha"), port("a", "aside") == F.col("ha"), "left").join(known("hb"), port("b", "bside") == F.col("hb"), "left")
        sure, rest = told.filter("ha IS NULL AND hb IS NULL").select(*ends.columns), told.filter("ha IS NOT NULL OR hb IS NOT NULL").select(*ends.columns)
    rest = store.write(rest)  # read twice
    there = F.struct(F.col("a").alias("node"), F.col("aside").alias("side"))
    back = F.struct(F.col("b").alias("node"), F.col("bside").alias("side"))
    both = rest.select("gap", "dist", F.explode(F.array(F.struct(there.alias("at"), back.alias("to")), F.struct(back.alias("at"), there.alias("to")))).alias("x"))
    best = both.groupBy("x.at").agg(F.min(F.struct("dist", "gap", "x.to")).alias("m")).select("m.gap", "m.dist", F.least("at", "m.to").alias("lo"), F.greatest("at", "m.to").alias("hi"))
    mutual = best.groupBy("gap", "dist", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    mutual = store.write(mutual.select("gap", "dist", F.col("lo.node").alias("a"), F.col("lo.side").alias("aside"), F.col("hi.node").alias("b"), F.col("hi.side").alias("bside")))
    over = rest.select("gap").join(mutual.select("gap"), "gap", "left_anti").distinct()
    return mutual if sure is None else sure.unionByName(mutual), over


def _pieces(rows: DataFrame, store: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments that meet others, with each ring cut at the left side of its least node: (rows, pieces, gaps cut).

    A fragment in which a ring is cut is two pieces of that name; ``part`` tells them apart. pieces: (frag, part, a, ao, k, b, bo, label), the label that of
    their walk.
    """
    edges = rows.filter("p = 0").select("frag", F.col("comp").alias("a")).join(rows.filter("p = k").select("frag", F.col("comp").alias("b")), "frag")
    edges = store.write(edges)
    labels, _ = component_labels(edges.select("a", "b"))
    labels = store.write(labels)
    own = store.write(edges.join(labels, F.col("a") == F.col("node")).select("frag", "label"))
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("links")).join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")), "label")
    rings = own.join(sizes.filter("links = nodes"), "label", "left_semi").select("frag", "label")
    inside = rows.join(rings, "frag")
    least = inside.groupBy("label").agg(F.min("comp").alias("comp"))
    # entered by its left side, a node that reads forward has the gap there behind it
    forward = F.col("orientation") == "+"
    at = inside.join(least, ["label", "comp"], "left_semi").select("frag", F.when(forward, F.col("p") - 1).otherwise(F.col("p")).alias("j"), F.when(forward, F.col("back")).otherwise(F.col("gap")).alias("cut"))
    cut = store.write(at.filter("cut IS NOT NULL"))
    j, p, k = F.col("j"), F.col("p"), F.col("k")
    second = j.isNotNull() & (p > j)
    none = lambda when, c: F.when(when, None).otherwise(F.col(c))
    ahead, behind = F.coalesce(p == j, F.lit(False)), F.coalesce(p == j + 1, F.lit(False))
    held = rows.join(cut.select("frag", "j"), "frag", "left").select(
        "frag", second.cast("int").alias("part"), F.when(second, p - j - 1).otherwise(p).alias("p"), F.when(j.isNull(), k).when(second, k - j - 1).otherwise(j).alias("k"),
        "comp", "orientation", none(ahead, "gap").alias("gap"), none(ahead, "dist").alias("dist"), none(behind, "back").alias("back"), none(behind, "back_dist").alias("back_dist"),
    )
    held = store.write(held.filter("k > 0"))
    first = held.filter("p = 0").select("frag", "part", F.col("comp").alias("a"), F.col("orientation").alias("ao"), "k")
    pieces = store.write(first.join(held.filter("p = k").select("frag", "part", F.col("comp").alias("b"), F.col("orientation").alias("bo")), ["frag", "part"]).join(own, "frag"))
    return held, pieces, cut.select(F.col("cut").alias("gap"))


def _ranks(pieces: DataFrame, store: Rounds) -> DataFrame:
    """(head, node, o, rank): the ends of pieces in the order of their walk, by the links before them.

    States are (node, orientation), each with the state before it; ranks come from pointer doubling over those that have not reached an end,
    so rounds grow with the logarithm of the pieces of the longest walk. A walk begins at the end from which its first node reads forward; where
    both or neither do, at the lesser node.
    """
    before = pieces.select(F.col("b").alias("node"), F.col("bo").alias("o"), F.col("a").alias("up"), F.col("ao").alias("up_o"), F.col("k").alias("rank"), "label")
    before = store.write(before.unionByName(pieces.select(F.col("a").alias("node"), flip(F.col("ao")).alias("o"), F.col("b").alias("up"), flip(F.col("bo")).alias("up_o"), F.col("k").alias("rank"), "label")))
    heads = store.write(before.select(F.col("up").alias("node"), F.col("up_o").alias("o"), "label").join(before, ["node", "o"], "left_anti"))
    end = heads.select(F.col("node").alias("up"), F.col("o").alias("up_o"), F.lit(True).alias("ended"))
    state = store.write(before.join(end, ["up", "up_o"], "left").select("node", "o", "up", "up_o", "rank", F.coalesce("ended", F.lit(False)).alias("ended")))
    ranked = heads.select("node", "o", F.col("node").alias("up"), F.col("o").alias("up_o"), F.lit(0).cast("long").alias("rank"))
    known = None  # states that ended in earlier rounds; later ones may still point at them
    while True:
        now = state.filter("ended")
        far = (state if known is None else state.unionByName(known)).select(F.col("node").alias("up"), F.col("o").alias("up_o"), F.col("up").alias("next"), F.col("up_o").alias("next_o"), F.col("rank").alias("more"), F.col("ended").alias("there"))
        known = now if known is None else known.unionByName(now)
        open_ = state.filter("NOT ended")
        if open_.isEmpty():
            break
        state = store.write(open_.join(far, ["up", "up_o"]).select("node", "o", F.col("next").alias("up"), F.col("next_o").alias("up_o"), (F.col("rank") + F.col("more")).alias("rank"), F.col("there").alias("ended")))
    ranked = ranked.unionByName(known.drop("ended"))
    first = heads.groupBy("label").agg(F.min(F.struct(F.when(F.col("o") == "+", 0).otherwise(1).alias("turned"), "node", "o")).alias("h")).select(F.col("h.node").alias("up"), F.col("h.o").alias("up_o"))
    return ranked.join(first, ["up", "up_o"], "left_semi").select(F.col("up").alias("head"), "node", "o", "rank")


def _walked(gaps: DataFrame, batch: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """(head, ord, comp, orientation, gap, dist) of the segments with gaps to walk, dist that of the gap; and the gaps left over, as ``gap_walks`` has them."""
    store = Rounds(gaps.sparkSession, keep=1 << 30)
    links, over = _links(_ends(gaps.filter("s1 <> s2")), store)
    local = store.write(fragments(links, batch))
    left = gaps.filter("s1 = s2").select(F.col("header").alias("gap"), F.lit("terminal").alias("reason"))
    if over is not None:
        left = left.unionByName(over.select("gap", F.lit("branch").alias("reason")))
    plain = lambda df: df.select("head", (F.col("p") + 1).alias("ord"), "comp", "orientation", "gap", "dist")
    ends = local.filter("p = 0 OR p = k").select("frag", "comp")
    shared = ends.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    met = store.write(ends.join(shared, "comp", "left_semi").select("frag").distinct())
    if met.isEmpty():
        return plain(local), left
    rows, pieces, cut = _pieces(store.write(local.join(met, "frag", "left_semi")), store)
    ranks = store.write(_ranks(pieces, store))
    own = pieces.join(ranks, F.col("a") == F.col("node"))
    same = F.col("o") == F.col("ao")
    place = own.select("frag", "part", "head", same.alias("same"), F.when(same, F.col("rank")).otherwise(F.col("rank") - F.col("k")).alias("off"))
    turn = lambda one, other: F.when(F.col("same"), one).otherwise(other)
    inner = rows.join(place, ["frag", "part"]).filter("(same AND p < k) OR (NOT same AND p > 0)")
    inner = inner.select(
        "head", (F.col("off") + turn(F.col("p"), F.col("k") - F.col("p")) + 1).alias("ord"), "comp", turn(F.col("orientation"), flip(F.col("orientation"))).alias("orientation"),
        turn(F.col("gap"), F.col("back")).alias("gap"), turn(F.col("dist"), F.col("back_dist")).alias("dist"),
    )
    tails = ranks.groupBy("head").agg(F.max(F.struct("rank", "node", "o")).alias("x"))
    kind = {f.name: f.dataType for f in local.schema}
    tails = tails.select("head", (F.col("x.rank") + 1).alias("ord"), F.col("x.node").alias("comp"), F.col("x.o").alias("orientation"), F.lit(None).cast(kind["gap"]).alias("gap"), F.lit(None).cast(kind["dist"]).alias("dist"))
    alone = plain(local.join(met, "frag", "left_anti"))
    return alone.unionByName(inner).unionByName(tails), left.unionByName(cut.select("gap", F.lit("ring").alias("reason")))


def _path_of(head: Column) -> Column:
    return F.concat(head.cast("string"), F.lit("_path"))


def gap_walks(nodes: DataFrame, gaps: DataFrame, batch: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """Walks through the gap graph, turned segments and rings included: (steps, gaps left over).

    steps: (path, ord, comp, orientation, gap), each node once; ``gap`` leads to the next step. A path is called ``<first segment>_path``.
    left over: (gap, reason): every gap that is no step, so none is lost.

    * A gap of a segment with itself is ``terminal``.
    * Of several gaps at a side only the one of least distance, then least name, may be walked, and is if it is that at its other
      side too; the others are a ``branch``.
    * A ring is cut at the left side of its least segment; the gap there closes a ``ring``.
    * A path begins at the end from which its first segment reads forward; where both or neither do, at the lesser segment.

    Tasks join the links that they read to fragments, ``batch`` of them at a time; only fragments that meet others are joined and ranked between tasks.
    """
    walked, left = _walked(gaps, batch)
    alone = nodes.select(F.col("node").alias("comp")).join(walked.select("comp"), "comp", "left_anti")
    alone = alone.select(F.col("comp").alias("head"), F.lit(1).cast("long").alias("ord"), "comp", F.lit("+").alias("orientation"), F.lit(None).cast("string").alias("gap"))
    steps = walked.drop("dist").unionByName(alone)
    return steps.select(_path_of(F.col("head")).alias("path"), "ord", "comp", "orientation", "gap"), left


def discover_paths(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(path, ord, comp, orientation, gap): the walks of ``gap_walks``; gaps without a header are told apart by their ends."""
    if "header" not in gaps.columns:
        gaps = gaps.withColumn("header", F.concat_ws("_", "s1", "s2"))
    rows = gaps.withColumns({c: F.lit("+") for c in ("s1_or", "s2_or") if c not in gaps.columns} | {"dist": F.lit(0).cast("long") if "dist" not in gaps.columns else F.col("dist")})
    return gap_walks(nodes, rows)[0]


def scaffold_walk(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(path, n, size, a, c, g, t, lower): segments, length with gaps, and bases of each walk, those of a turned segment complemented. ``nodes`` has
    node, len, a, c, g, t, lower. Terminal gaps count where their segment stands at the end of its path that they hang on."""
    walked, _ = _walked(gaps)
    # + + hangs on the left side, + - on the right
    hung = gaps.filter("s1 = s2").groupBy(F.col("s1").alias("comp")).agg(F.sum(F.when(F.col("s2_or") == "+", F.col("dist"))).alias("on_left"), F.sum(F.when(F.col("s2_or") != "+", F.col("dist"))).alias("on_right"))
    rows = nodes.withColumnRenamed("node", "comp").join(walked, "comp", "left").join(hung, "comp", "left").withColumn("orientation", F.coalesce("orientation", F.lit("+"))).withColumn("head", F.coalesce("head", "comp"))
    turned = F.col("orientation") == "-"
    first, last = F.coalesce("ord", F.lit(1)) == 1, F.col("gap").isNull()
    outside = [F.when(at, F.coalesce(F.when(turned, F.col(two)).otherwise(F.col(one)), F.lit(0))).otherwise(0) for at, one, two in ((first, "on_left", "on_right"), (last, "on_right", "on_left"))]
    pick = lambda one, other: F.sum(F.when(turned, F.col(other)).otherwise(F.col(one)))
    sizes = rows.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("len") + F.coalesce("dist", F.lit(0)) + outside[0] + outside[1]).alias("size"), pick("a", "t").alias("a"), pick("c", "g").alias("c"), pick("g", "c").alias("g"), pick("t", "a").alias("t"), F.sum("lower").alias("lower"),
    )
    return sizes.select(_path_of(F.col("head")).alias("path"), "n", "size", "a", "c", "g", "t", "lower")


def _chains(links: DataFrame, sources: DataFrame, store: Rounds) -> tuple[DataFrame, DataFrame]:
    """(inner, roots): nodes inside chains, and (end, node, w) for every link: where the way that leads into ``node`` by it leaves a node that is not inside
    a chain, and its weight from there.

    Inside are nodes but sources that have the same two neighbours ahead and behind. Ways back through them are doubled, so rounds grow with the
    logarithm of the longest chain; what is open after as many is a ring without a source, and unreachable.
    """
    ends = lambda one, two, name: links.groupBy(F.col(one).alias("node")).agg(F.min(two).alias(f"{name}_lo"), F.max(two).alias(f"{name}_hi"), F.count(F.lit(1)).alias(f"{name}_n"))
    inner = ends("node", "other", "out").join(ends("other", "node", "in"), "node").filter("out_n = 2 AND in_n = 2 AND out_lo = in_lo AND out_hi = in_hi")
    inner = store.write(inner.join(sources.select("node"), "node", "left_anti").select("node", F.col("in_lo").alias("lo"), F.col("in_hi").alias("hi")))
    own = links.join(inner, "node", "left")
    behind = F.when(F.col("lo") == F.col("other"), F.col("hi")).otherwise(F.col("lo"))
    roots = store.write(own.filter("lo IS NULL").select("node", "other", F.col("node").alias("end"), "w"))
    state = store.write(own.filter("lo IS NOT NULL").select("node", "other", behind.alias("up"), F.col("node").alias("up_to"), "w"))
    left = max(1, state.count()).bit_length() + 1
    while left and not state.isEmpty():
        left -= 1
        over = roots.select(F.col("node").alias("up"), F.col("other").alias("up_to"), "end", F.col("w").alias("more"))
        there = state.join(over, ["up", "up_to"]).select("node", "other", "end", (F.col("w") + F.col("more")).alias("w"))
        on = state.select(F.col("node").alias("up"), F.col("other").alias("up_to"), F.col("up").alias("next"), F.col("up_to").alias("next_to"), F.col("w").alias("more"))
        fresh = store.write(there)
        state = store.write(state.join(on, ["up", "up_to"]).select("node", "other", F.col("next").alias("up"), F.col("next_to").alias("up_to"), (F.col("w") + F.col("more")).alias("w")))
        roots = roots.unionByName(fresh)
    return inner.select("node"), roots.select("end", F.col("other").alias("node"), "w")


def shortest_distances(adj: DataFrame, sources: DataFrame, weight: str | None = None, previous: bool = False, limit: int = LIMIT) -> DataFrame:
    """(node, dist) from the nearest source, by weights that are not negative; with ``previous`` also the node before it on a shortest way (null at a source).

    Chains of nodes with two neighbours are links of their length, and only nodes between chains are settled, in blocks of at most ``limit``
    links: rounds grow with the blocks that a way crosses, and with the logarithm of the longest chain. Nodes inside get theirs from the ends.
    Null sources and links with a null end are left out; a source without links has distance 0.
    """
    w = F.col(weight) if weight else F.lit(1)
    store = Rounds(adj.sparkSession, keep=1 << 30)
    links = store.write(adj.filter("node <> other").groupBy("node", "other").agg(F.min(w.cast("double")).alias("w")))
    sources = store.write(sources.select("node").filter("node IS NOT NULL").distinct())
    with without_broadcasts(adj.sparkSession):
        inner, roots = _chains(links, sources, store)
        roots = store.write(roots)
        short = store.write(roots.join(inner, "node", "left_anti").groupBy(F.col("end").alias("node"), F.col("node").alias("other")).agg(F.min("w").alias("w")))
        dist = distances(short, sources, limit)
    inside = roots.join(inner, "node", "left_semi").join(dist.withColumnRenamed("node", "end"), "end").groupBy("node").agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    found = dist.unionByName(inside)
    if not previous:
        return found
    found = store.write(found)
    step = links.join(found, "node").select(F.col("other").alias("node"), (F.col("dist") + F.col("w")).alias("via"), F.col("node").alias("before"), F.col("dist").alias("there"))
    least = step.join(found, "node").filter("via = dist AND dist > 0").groupBy("node").agg(F.min(F.struct("there", "before")).getField("before").alias("previous"))
    return found.join(least, "node", "left")
