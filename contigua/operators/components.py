"""Connected components by contraction: the one implementation that graphs and near-duplicates share.

A round sends each node to the least of itself and its neighbours in an order drawn anew each round, follows these
pointers twice more, and replaces the ends of all edges by where they lead. Of neighbouring nodes at most one
is least, and the chains of pointers of a random order are short, so each round leaves a fraction of the nodes: rounds
grow with the logarithm of the number of nodes, whatever the graph's shape or its names. Edges that join
equal nodes vanish. A pointer that has not reached its end stays as an edge, so nothing comes apart.

Hot nodes: minima are pre-aggregated before the shuffle; joins of edges with pointers have a row a node on one
side, so adaptive execution may split the other. When at most ``SMALL`` edges are left, one task unites them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contigua.operators.lineage import Rounds

#: So many edges (two keys each) are united in one task instead of in further rounds.
SMALL = 100_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of at most SMALL edges: union by find with halved paths, the least node as root."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(up.setdefault(a, a)), find(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "label"])


def component_labels(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, int]:
    """(node, label) with the least node of each component, for all ends of the edges (a, b); and the rounds taken.

    Edges may repeat and point either way; edges with a null end are left out.
    """
    spark = edges.sparkSession
    store = Rounds(spark, keep=1 << 30)
    kind = edges.schema["a"].dataType.simpleString()
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = store.write(edges.select("a", "b"))  # it is read twice
    left = store.write(ordered(edges))
    alone = edges.filter("a = b").select(F.col("a").alias("node"))
    steps: list[DataFrame] = []
    while left.count() > small:
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("node"), key("b").alias("k")).union(left.select("b", key("a")))
        up = store.write(both.groupBy("node").agg(F.min("k").alias("k")).select("node", F.least(key("node"), "k").getField("v").alias("up")))
        twice = store.write(up.join(up.toDF("up", "next"), "up").select("node", F.col("next").alias("up")))
        far = store.write(twice.join(up.toDF("up", "next"), "up").select("node", F.col("up").alias("at"), F.col("next").alias("up")))
        to = far.select("node", "up")
        moved = left.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        unfinished = to.select(F.col("up").alias("a")).distinct().join(up.toDF("a", "b"), "a")
        steps.append(to)
        left = store.write(ordered(moved.union(unfinished)))
    labels = store.write(left.coalesce(1).mapInArrow(_unite, f"node {kind}, label {kind}"))
    for to in reversed(steps):
        known = to.join(labels.toDF("up", "label"), "up", "left").select("node", F.coalesce("label", "up").alias("label"))
        labels = store.write(known)
    if steps:  # roots of contracted graphs need not be the least of their component
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = store.write(labels.join(least, "label").select("node", F.col("least").alias("label")))
    done = labels.union(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")).distinct())
    return done, len(steps)
