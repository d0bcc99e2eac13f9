"""Shortest ways block by block: a task settles all ways inside a block with a heap, blocks exchange only what crosses.

Neighbouring nodes are clustered by contraction and clusters dealt to blocks of a bounded number of links, so a way of many
hops crosses few blocks. Rounds grow with the blocks that a shortest way crosses, not with its hops; a graph of at
most ``LIMIT`` links is one block and takes one round. How nodes are dealt changes rounds, never results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from contigua.operators.lineage import Rounds

#: Links that one task settles at once.
LIMIT = 200_000


def _clusters(links: DataFrame, wanted: int, store: Rounds) -> DataFrame:
    """(node, cluster): some ``wanted`` clusters of neighbouring nodes. In each round a cluster goes to the least of itself and its
    neighbours in an order drawn anew, so rounds grow with the logarithm of the nodes a cluster; clusters without links left stay."""
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at = store.write(links.select("node").union(links.select("other")).distinct().withColumn("cluster", F.col("node")))
    left = store.write(ordered(links.toDF("a", "b", "w").select("a", "b")))
    turn = 0
    while True:
        open_ = left.select(F.col("a").alias("c")).union(left.select("b")).distinct().count()
        if open_ <= wanted:
            return at
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("c"), key("b").alias("k")).union(left.select("b", key("a")))
        up = store.write(both.groupBy("c").agg(F.min("k").alias("k")).select("c", F.least(key("c"), "k").getField("v").alias("up")))
        at = store.write(at.join(up, F.col("cluster") == F.col("c"), "left").select("node", F.coalesce("up", "cluster").alias("cluster")))
        left = store.write(ordered(left.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
        turn += 1


def deal(links: DataFrame, count: int, limit: int, store: Rounds) -> DataFrame:
    """(node, block) for all ends of the ``count`` links (node, other, w). Clusters of more than ``limit`` links are cut by the hash of their
    nodes, those of less than an eighth share blocks of half the limit on average."""
    at = _clusters(links, 8 * math.ceil(count / limit), store)
    sizes = links.join(at, "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = at.join(sizes, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col("n"), F.lit(1)) / limit))
    shared = F.pmod(F.xxhash64("cluster"), F.lit(2 * math.ceil(count / limit)))
    return rows.select("node", F.when(F.col("n") * 8 < limit, shared).otherwise(F.xxhash64("cluster", piece)).alias("block"))


def _settle(links: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """One block: from the nodes that are nearer than before (``fresh``) to all that come nearer through the block's own links."""
    if not len(state):
        return state[["block", "node", "dist"]]
    codes, names = pd.factorize(pd.concat([state["node"], links["node"], links["other"]], ignore_index=True))
    own, begin, end = np.split(codes, [len(state), len(state) + len(links)])
    order = np.argsort(begin, kind="stable")
    first = np.searchsorted(begin[order], np.arange(len(names) + 1))
    to, weight = end[order], links["w"].to_numpy()[order]
    best = np.full(len(names), np.inf)
    np.minimum.at(best, own, state["dist"].to_numpy())
    nearer = {int(i) for i in own[state["fresh"].to_numpy(dtype=bool)]}
    heap = [(best[i], i) for i in nearer]
    heapq.heapify(heap)
    while heap:
        dist, i = heapq.heappop(heap)
        if dist > best[i]:
            continue
        for j, w in zip(to[first[i] : first[i + 1]].tolist(), weight[first[i] : first[i + 1]].tolist()):
            if dist + w < best[j]:
                best[j] = dist + w
                nearer.add(j)
                heapq.heappush(heap, (dist + w, j))
    moved = np.fromiter(nearer, np.int64, len(nearer))
    return pd.DataFrame({"block": state["block"].iloc[0], "node": names[moved], "dist": best[moved]})


def distances(links: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, dist) of the nodes reached from the sources (node) along links (node, other, w), one a pair, by weights that are not negative; no node is null.

    ``links`` and ``sources`` are read often: give written tables. A node's links across blocks are met by a join, so a node
    with very many of them is no task's burden.
    """
    spark, kind = links.sparkSession, links.schema["node"].dataType.simpleString()
    store, rounds = Rounds(spark, keep=1 << 30), Rounds(spark, keep=4)
    count = links.count()
    if count <= limit:
        inner, cross = links.withColumn("block", F.lit(0).cast("long")), None
        fresh = sources.select(F.lit(0).cast("long").alias("block"), "node", F.lit(0.0).alias("dist"))
    else:
        place = store.write(deal(links, count, limit, store))
        held = store.write(links.join(place, "node").join(place.toDF("other", "to"), "other"))
        inner, cross = held.filter("block = to").drop("to"), held.filter("block <> to").drop("block")
        # a source without links has no block; any will do
        fresh = rounds.write(sources.join(place, "node", "left").select(F.coalesce("block", F.lit(0)).cast("long").alias("block"), "node", F.lit(0.0).alias("dist")))
    shape = f"block long, node {kind}, dist double"
    dist = spark.createDataFrame([], shape)
    while True:
        active = fresh.select("block").distinct()
        state = dist.join(active, "block", "left_semi").withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
        own = inner.join(active, "block", "left_semi").select("block", "node", "other", "w")
        settled = rounds.write(own.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(_settle, shape))
        if cross is None:
            return settled.select("node", "dist")
        dist = rounds.write(dist.join(settled.select("node"), "node", "left_anti").select("block", "node", "dist").unionByName(settled))
        reach = settled.select("node", "dist").join(cross, "node").groupBy(F.col("to").alias("block"), F.col("other").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        fresh = rounds.write(reach.join(dist.select("node", F.col("dist").alias("old")), "node", "left").filter("old IS NULL OR dist < old").select("block", "node", "dist"))
        if fresh.isEmpty():
            return dist.select("node", "dist")
