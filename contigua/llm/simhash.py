"""SimHash near-duplicates: vantage-point tree over fingerprints, exact pairs within a Hamming radius.

1. Fingerprints: one pass over the texts (Arrow batches), 64-bit SimHash over word shingles.
2. Equal fingerprints are one node from here on, so a group of exact copies costs one node.
3. A vantage-point tree is built on the driver from a bounded sample of distinct fingerprints. It only
   routes: its depth follows the number of distinct fingerprints so that a leaf (a shard) holds about
   ``leaf_target``. Every fingerprint has one home shard; by the triangle inequality
   |d(x,v) - d(y,v)| <= d(x,y), it is also sent to each later shard whose boundary lies within the radius.
4. Each shard finds all its pairs within the radius with a vantage-point tree of its own and returns a
   spanning forest of them: the links' components, never all pairs of a group.
5. Components of the forests' edges by contraction (``operators.components``).

The pipeline's stage (``keep_one`` with ``similarity``) has parameters of its own: sets of five-word shingles, linked at an
exact Jaccard similarity of 0.8. At that similarity fingerprints lie 9.7 +- 2.9 bits apart (12 +- 3.1 where the sets hold few
shingles), so radius 24 of one and 40 of two together lose a pair with a probability of 4e-6 (few shingles: 3.5e-4). The same tree finds the
pairs within that radius; two more fingerprints (80 bits of all four, which such a pair exceeds with 6e-7 at most) and the sizes
of the sets leave few pairs of unrelated texts to be verified by the sets themselves. At such a radius the bounds exclude next to
nothing, as unrelated texts lie 32 +- 4 bits apart: the comparisons are those of all pairs of sets whose sizes allow the similarity.

Nothing is capped or sampled away: the sample chooses where to split, not what is compared. A leaf of that stage's tree with more than
``BUCKET`` sets is dealt as several pieces and pieces meet in pairs, so a task's memory is bounded, however many fingerprints are equal.
The cost to know: 64-bit fingerprints of unrelated texts lie 32 +- 4 bits apart, so a split at radius 4
excludes only part of the other side (measured: a fingerprint visits about 1.7 of 2 children).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contigua.llm.common import cut, give_back, once, row_key, shuffle_width, sized, stored
from contigua.operators.components import component_labels

SEED = 42
ROWS_AT_ONCE = 1 << 15
#: The sets of a piece of the stage's tree, and the bits in which the four fingerprints of similar sets differ at most.
BUCKET, MOST_BITS = 1 << 17, 80
#: Rows that a task deals at a time.
DEALT_AT_ONCE = 1 << 18
#: The columns of a set of shingles that are dealt.
DEALT = ("node", "fp", "fp2", "fp3", "fp4", "n", "label")
#: At most so many fingerprints (8 bytes each) reach the driver to place the tree's splits.
MOST_SAMPLE = 1 << 20


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, in order: A-Z lower-cased, words split at ASCII white space.

    Null or wordless: none. Fewer words than ``shingle``: the whole sequence is the one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[at : at + ROWS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash64(text: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of a UTF-8 text, from its shingles with their repeats. Null or wordless: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, *more: str) -> DataFrame:
    """``id_col``, ``fp`` (the 64 bits as a signed long), and the longs ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash64(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=[id_col, "fp", *more])

    schema = ", ".join(f"{c} long" for c in (id_col, "fp", *more))
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").cast("binary").alias("text"), *more).mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def vantage(points: np.ndarray, candidates: int = 16) -> np.uint64:
    """Of a few points, that whose distances spread most: the best at telling sides apart."""
    step = max(1, len(points) // candidates)
    return max(points[::step][:candidates], key=lambda p: float(distance(points[:2048], p).astype(float).std()))


def routing_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree, node i's children at 2i+1 (inside) and 2i+2."""
    n = (1 << depth) - 1
    points, radii = np.zeros(n, np.uint64), np.full(n, 64, np.int16)
    held = {0: sample}
    for i in range(n):
        own = held.pop(i, sample[:0])
        if len(own):
            points[i] = vantage(own)
            d = distance(own, points[i]).astype(np.int16)
            radii[i] = int(np.median(d))
            inside = d <= radii[i]
            held[2 * i + 1], held[2 * i + 2] = own[inside], own[~inside]
    return points, radii


def route(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int, at_home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for each fingerprint's home shard and the later shards that may hold a neighbour.

    Not ``at_home``: of all shards those that may hold a neighbour, as a visitor.
    """
    points, radii = tree
    rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    home = np.full(len(fps), at_home)
    for _ in range(depth):
        d, t = distance(fps[rows], points[nodes]).astype(np.int16), radii[nodes]
        inside = d <= t
        first, second = 2 * nodes + 1, 2 * nodes + 2
        cross = inside & (d + radius > t)  # homes only visit later shards; visitors go where the bounds allow
        vis_in, vis_out = ~home & (d - radius <= t), ~home & (d + radius > t)
        h_in, h_out = home & inside, home & ~inside
        h_cross = home & cross
        parts = [(h_in, first, True), (h_out, second, True), (h_cross, second, False), (vis_in, first, False), (vis_out, second, False)]
        rows, nodes, home = (
            np.concatenate([rows[m] for m, _, _ in parts]),
            np.concatenate([child[m] for m, child, _ in parts]),
            np.concatenate([np.full(int(m.sum()), h) for m, _, h in parts]),
        )
    return rows, nodes - ((1 << depth) - 1), home


class Forest:
    """Union-find over positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a) > 64:  # many pairs of few trees: as roots, most are equal
            roots = self.roots(np.concatenate([a, b]))
            a, b = roots[: len(a)], roots[len(a) :]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        else:
            pairs = np.stack([a, b], 1)
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y


def tree_leaves(fps: np.ndarray, members: np.ndarray, asking: np.ndarray, radius: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, asking) of each leaf of a vantage-point tree over the members; asking rows go where the bounds allow a neighbour."""
    stack = [(members, asking)]
    while stack:
        own, some = stack.pop()
        if not len(own) or not len(some):
            continue
        if len(own) > leaf:
            v = vantage(fps[own])
            d, q = distance(fps[own], v).astype(np.int16), distance(fps[some], v).astype(np.int16)
            t = int(np.median(d))
            inside = d <= t
            if inside.any() and not inside.all():
                stack.append((own[inside], some[q - radius <= t]))
                stack.append((own[~inside], some[q + radius > t]))
                continue
        yield own, some


def link_shard(fps: np.ndarray, members: np.ndarray, radius: int, forest: Forest, leaf: int = 512) -> None:
    """Joins in ``forest`` every pair (any row, member row) within the radius."""
    for own, asking in tree_leaves(fps, members, np.arange(len(fps)), radius, leaf):
        for at in range(0, len(own), 1024):
            block = own[at : at + 1024]
            for start in range(0, len(asking), 1024):
                some = asking[start : start + 1024]
                i, j = np.nonzero(distance(fps[some][:, None], fps[block][None, :]) <= radius)
                a, b = some[i], block[j]
                real = a != b
                if real.any():
                    forest.join(a[real], b[real])


def grown_tree(distinct: DataFrame, leaf_target: int, least_depth: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """(routing tree, its depth) for distinct ``fp``, of which a bounded sample reaches the driver."""
    n = distinct.count()
    sample_rows = min(MOST_SAMPLE, max(16_384, 16 * n // leaf_target))
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample_rows).collect()], np.int64).view(np.uint64)
    depth = least_depth
    while (n >> depth) > leaf_target and (8 << depth) < sample_rows:
        depth += 1
    return routing_tree(sample, depth), depth


def near_links(distinct: DataFrame, radius: int = 4, leaf_target: int = 8192, least_depth: int = 5) -> DataFrame:
    """Edges (a, b) of a spanning forest, per shard, of all pairs of distinct ``fp`` within ``radius``.

    The tree's depth follows the number of fingerprints, so shards stay near ``leaf_target`` up to 2**30 of them; beyond,
    MOST_SAMPLE bounds the tree and shards grow.
    """
    grown, depth = grown_tree(distinct, leaf_target, least_depth)
    tree = distinct.sparkSession.sparkContext.broadcast(grown)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096].view(np.uint64)
                rows, shards, home = route(fps, tree.value, depth, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", kind="stable")
        fps = pdf["fp"].to_numpy().view(np.uint64)
        forest = Forest(len(fps))
        link_shard(fps, np.flatnonzero(pdf["home"].to_numpy()), radius, forest)
        roots = forest.roots(np.arange(len(fps)))
        linked = np.flatnonzero(roots != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[roots[linked]].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean").groupBy("shard").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links).

    Defined results: null, empty and wordless texts have fingerprint 0 and link like any other; rows with
    equal fingerprints are one component, repeated rows included; a null id is ignored when the smallest
    is sought; other columns are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels, _ = component_labels(near_links(distinct, radius))
    linked = stored(distinct.join(labels.toDF("fp", "label"), "fp"))  # a fingerprint without links is a component
    reach = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    far = linked.join(reach, "label").select("fp", "component_id")
    known = stored(distinct.join(far, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(known, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sketches(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Of rows with ``k1``, ``k2`` and ``__id``: these, ``node`` (hash of the set of shingles), ``fp`` to ``fp4`` (four fingerprints of
    that set), ``n`` (its size)."""
    names = ["k1", "k2", "__id", *DEALT[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((6, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(3)):
                own = shingle_set(text.as_py(), shingle)
                out[:, i] = xxhash.xxh64_intdigest(own.tobytes()), majority(own), *(majority(_mixed(own, salt)) for salt in range(3)), len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c.view(np.int64)) for c in out)], names=names)
        give_back()

    return rows.select("k1", "k2", "__id", F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def dealt(nodes: DataFrame, radius: int, bucket: int, least_depth: int = 4) -> DataFrame:
    """(lo, hi, side, *DEALT), ordered: each node with its piece ``side``, once for each piece that may hold a neighbour of it.

    A piece is a leaf of the routing tree, or one of several parts of a leaf of more than ``bucket`` nodes. Two nodes within
    the radius meet in one pair of pieces (lo, hi) and no other.
    """
    spark = nodes.sparkSession
    tree, depth = grown_tree(nodes.select("fp").distinct(), bucket, least_depth)
    routing = spark.sparkContext.broadcast(tree)

    def homes(fps: np.ndarray) -> np.ndarray:
        rows, leaves, _ = route(fps, routing.value, depth, 0)  # at radius 0 nobody visits
        return leaves[np.argsort(rows)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, m = np.unique(homes(batch.column(0).to_numpy().view(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(m, pa.int64())], names=["leaf", "m"])

    held = np.zeros(1 << depth, np.int64)
    for leaf, m in nodes.select("fp").mapInArrow(count, "leaf long, m long").groupBy("leaf").agg(F.sum("m")).collect():
        held[leaf] = m
    parts = np.maximum(1, -(-held // bucket))
    first = np.cumsum(parts) - parts
    step = max(1, DEALT_AT_ONCE // int(parts.sum()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                node, fps = (part.column(i).to_numpy().view(np.uint64) for i in range(2))
                home = homes(fps)
                own = first[home] + (node % parts[home].astype(np.uint64)).astype(np.int64)
                rows, leaves, _ = route(fps, routing.value, depth, radius, at_home=False)
                many = parts[leaves]
                other = np.arange(many.sum()) + np.repeat(first[leaves] - np.cumsum(many) + many, many)
                rows = np.repeat(rows, many)
                pair = (np.minimum(own[rows], other), np.maximum(own[rows], other), own[rows])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in pair), *(c.take(pa.array(rows)) for c in part.columns)], names=["lo", "hi", "side", *DEALT])

    return _by_pieces(nodes.select(*DEALT).mapInArrow(deal, "lo int, hi int, side int, " + ", ".join(f"{c} long" for c in DEALT)))


def _by_pieces(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "lo", "hi").sortWithinPartitions("lo", "hi", "n", "node")


def in_pieces(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], list[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``solve`` finds in each pair of pieces of two or more rows; rows are in order of their first two columns. One pair is held."""
    held: list[pa.RecordBatch] = []
    at = None

    def found() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        out = solve(table) if table.num_rows > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * len(names)], names=names)

    for batch in batches:
        lo, hi = (batch.column(i).to_numpy() for i in range(2))
        edges = [0, *(np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if at != (lo[a], hi[a]) and held:
                    yield from found()
                    held = []
                at = (lo[a], hi[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield from found()
    give_back()


def near_pairs(pieces: pa.Table, similarity: float, radius: int, both: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some at a time, the pairs of rows (a, b) of two pieces, or of one with itself, that ``candidates`` asks for, and their distance.

    Rows are in order of ``n``. The tree's leaves are compared in blocks of like size, with the sizes that the similarity allows.
    """
    c = {name: pieces.column(name).to_numpy() for name in ("lo", "hi", "side", *DEALT)}
    prints = [c[name].view(np.uint64) for name in DEALT[1:5]]
    n, label, fp = c["n"], c["label"], prints[0]
    across = c["lo"][0] != c["hi"][0]
    own, asking = (np.flatnonzero(c["side"] == c[end]) for end in ("lo", "hi"))
    for members, some in tree_leaves(fp, own, asking, radius, 4096):
        sizes = n[some]
        for at in range(0, len(members), 256):
            block = members[at : at + 256]
            start = np.searchsorted(sizes, similarity * n[block[0]] - 1e-6) if across else np.searchsorted(some, block[0], "right")
            stop = np.searchsorted(sizes, n[block[-1]] / similarity + 1e-6, "right")
            for place in range(start, stop, 1024):
                far = some[place : min(place + 1024, stop)]
                i, j = np.nonzero(distance(fp[block][:, None], fp[far][None, :]) <= radius)
                a, b = block[i], far[j]
                if not across:
                    a, b = a[a < b], b[a < b]
                d = distance(prints[0][a], prints[0][b]) + distance(prints[1][a], prints[1][b])
                a, b, d = (x[d <= both] for x in (a, b, d))
                d = d + distance(prints[2][a], prints[2][b]) + distance(prints[3][a], prints[3][b])
                real = (d <= MOST_BITS) & (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6)
                if real.any():
                    yield a[real], b[real], d[real]


def forest_and_nearest(pieces: pa.Table, similarity: float, radius: int, both: int) -> list[tuple]:
    """Of all ``near_pairs``, as nodes, those of a spanning forest and of each row with its nearest."""
    m = pieces.num_rows
    forest = Forest(m)
    nearest, nearest_d = np.full(m, -1), np.full(m, 1 << 10)
    found: list[tuple[int, int]] = []
    for a, b, d in near_pairs(pieces, similarity, radius, both):
        order = np.argsort(d, kind="stable")
        a, b, d = a[order], b[order], d[order]
        for x, y in ((a, b), (b, a)):
            closer = np.flatnonzero(d < nearest_d[x])[::-1]  # the least is written last
            nearest[x[closer]], nearest_d[x[closer]] = y[closer], d[closer]
        ra, rb = forest.roots(a), forest.roots(b)
        apart = np.flatnonzero(ra != rb)
        _, first = np.unique((np.minimum(ra, rb) * m + np.maximum(ra, rb))[apart], return_index=True)
        for p in np.sort(apart[first]).tolist():
            x, y = forest.find(a[p]), forest.find(b[p])
            if x != y:
                forest.up[max(x, y)] = min(x, y)
                found.append((a[p], b[p]))
    with_near = np.flatnonzero(nearest >= 0)
    places = np.concatenate([np.array(found, np.int64).reshape(-1, 2), np.stack([with_near, nearest[with_near]], 1)])
    node = pieces.column("node").to_numpy()
    return list(map(tuple, np.unique(np.sort(node[places], axis=1), axis=0).tolist()))


def candidates(nodes: DataFrame, similarity: float, radius: int, both: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of ``node`` that the tree finds, whose ``label`` differ, whose sizes allow the similarity, and whose
    fingerprints lie within ``radius`` (the first), ``both`` (the first two together) and MOST_BITS (all).

    Of each pair of pieces only a spanning forest of them and each node's nearest, so that a large group
    of near copies gives pairs in proportion to its nodes.
    """
    return dealt(nodes, radius, bucket).mapInArrow(lambda batches: in_pieces(batches, lambda pieces: forest_and_nearest(pieces, similarity, radius, both), ["a", "b"]), "a long, b long").distinct()


def links_within(nodes: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float, radius: int, both: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of ``similarity`` that join all nodes of different ``label`` which any such links join.

    Every candidate pair is looked at, where its two pieces meet, and compared by its sets unless links found there
    have joined it already; only nodes that have such a pair bring their set there, and pairs as such never leave a task.
    """
    names = ["lo", "hi", "side", *DEALT]

    def asked(pieces: pa.Table) -> list[tuple]:
        open_ = np.zeros(pieces.num_rows, bool)
        for a, b, _ in near_pairs(pieces, similarity, radius, both):
            open_[a] = open_[b] = True
        return list(zip(*(c.to_pylist() for c in pieces.filter(pa.array(open_)).columns)))

    members = stored(dealt(nodes, radius, bucket).mapInArrow(lambda batches: in_pieces(batches, asked, names), ", ".join(f"{c} long" for c in names)))
    sets = held_sets(members.select("node").distinct(), nodes, rows, text_col, shingle)

    def check(pieces: pa.Table) -> list[tuple]:
        node, labels, held, out = pieces.column("node").to_numpy(), pieces.column("label").to_numpy(), pieces.column("held"), []
        sets: dict[int, np.ndarray] = {}
        forest = Forest(len(node))
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        forest.join(np.arange(len(node)), first[of])
        for a, b, _ in near_pairs(pieces, similarity, radius, both):
            apart = forest.roots(a) != forest.roots(b)
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if forest.find(x) != forest.find(y):
                    for i in (x, y):
                        if i not in sets:
                            sets[i] = np.frombuffer(held[i].as_buffer(), np.uint64)
                    if alike(sets[x], sets[y], similarity):
                        forest.join(np.array([x]), np.array([y]))
                        out.append((int(node[x]), int(node[y])))
        return out

    return _by_pieces(members.join(sets, "node").select(*names, "held")).mapInArrow(lambda batches: in_pieces(batches, check, ["a", "b"]), "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have that Jaccard similarity."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= similarity * (len(x) + len(y) - same) - 1e-9


def held_sets(asked: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, held): the sets of shingles of these nodes, stored; taken from the texts again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in part.column(1)], pa.binary())], names=["node", "held"])
        give_back()

    known = sized(stored(asked.join(nodes, "node").select("node", "key.k1", "key.k2")), 24)
    texts = once(rows.select("k1", "k2", F.col(text_col).cast("string").cast("binary").alias("text")).join(known, ["k1", "k2"]), "node")
    return stored(texts.select("node", "text").mapInArrow(sets, "node long, held binary"))


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least ``similarity``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    held = held_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, rows, text_col, shingle)
    left, right = held.toDF("a", "held_a"), held.toDF("b", "held_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "held_a", "held_b").mapInArrow(check, "a long, b long")


def similar_labels(rows: DataFrame, drawn: DataFrame, text_col: str, shingle: int, radius: int, both: int, similarity: float) -> DataFrame:
    """(node, label) of the components of all links of Jaccard ``similarity`` or more; nodes without links are left out.

    First a forest of the candidates is verified. Then every candidate pair that its links do not join already is.
    """
    nodes = stored(drawn.groupBy("node").agg(*(F.min(c).alias(c) for c in DEALT[1:-1]), F.min(_order()).alias("key")))
    large = nodes.filter(F.col("n") >= similarity / (1 - similarity) - 1e-6)  # smaller sets are equal or less similar
    first = stored(candidates(large.withColumn("label", F.col("node")), similarity, radius, both))
    links = stored(verified(first, rows, nodes, text_col, shingle, similarity))
    labels, _ = component_labels(links)
    named = stored(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select(*DEALT, "key"))
    return component_labels(links.union(stored(links_within(named, rows, text_col, shingle, similarity, radius, both))))[0]


def _order() -> Column:
    """What the kept row of a component has least: null ids last, then the id, then the key."""
    return F.struct(F.col("__id").isNull().alias("none"), "__id", "k1", "k2")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, both: int = 40, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, that with the smallest id.

    With ``similarity``, texts are linked by exact Jaccard similarity of their sets of shingles; the tree finds what is compared:
    fingerprints of the sets within ``radius``, and of two independent ones within ``both``.
    Rows are told apart by id and text, so ids may be null (last in order) or repeated; of rows equal in both one stays.
    Null and wordless texts are equal to each other; other columns pass through, an empty table stays empty.
    """
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    k1, k2 = row_key(doc, F.coalesce(text, F.lit("")))
    own = docs.select(doc.alias("__id"), text.alias("text"), k1, k2)
    if similarity is None:
        rows = stored(fingerprints(own, "__id", "text", shingle, "k1", "k2").withColumnRenamed("fp", "node"))
        labels, _ = component_labels(near_links(cut(rows.select(F.col("node").alias("fp")).distinct()), radius))
    else:
        rows = stored(sketches(own, "text", shingle))
        labels = similar_labels(own, rows, "text", shingle, radius, both, similarity)
    named = rows.join(labels, "node", "left").select("k1", "k2", "__id", F.coalesce("label", "node").alias("label"))
    first = named.groupBy("label").agg(F.min(_order()).alias("key")).select("key.k1", "key.k2")
    gone = sized(stored(named.select("k1", "k2").distinct().join(first, ["k1", "k2"], "left_anti").toDF("__k1", "__k2")))
    kept = docs.select("*", k1.alias("__k1"), k2.alias("__k2")).join(gone, ["__k1", "__k2"], "left_anti")
    return once(kept, "__k1", "__k2").select(*docs.columns)
