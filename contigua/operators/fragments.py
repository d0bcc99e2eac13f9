"""Chains of links contracted where they lie: a task joins the links that it reads to the longest pieces of walks it can see.

Whatever other tasks hold, a stretch of links that meet at a node's two sides is a stretch of some walk. Links of one walk mostly
lie together, so what is left for the joins between tasks follows the walks that tasks cut, not the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: So many links are joined at once; the bits below those of a fragment's batch hold a port (two a node).
LINKS = 1 << 18
_PORT_BITS, _BATCH_BITS = 20, 20


def _joined(links: pa.Table, base: int) -> pa.Table:
    """Rows of ``fragments`` for a batch of links. A port is a node's code and its side (odd: R); a link is followed from the port by which it
    leaves. Rings are not joined: each of their links is a fragment."""
    n = links.num_rows
    ends = pa.concat_arrays([c for name in ("a", "b") for c in links[name].chunks]).dictionary_encode()
    names, codes = ends.dictionary, ends.indices.to_numpy().astype(np.int64)
    side = lambda c: pc.equal(links[c], "R").to_numpy().astype(np.int64)
    one, two = codes[:n] * 2 + side("aside"), codes[n:] * 2 + side("bside")
    mate, link = np.full(2 * len(names), -1), np.zeros(2 * len(names), np.int64)
    mate[one], mate[two] = two, one
    link[one] = link[two] = np.arange(n)
    out = np.flatnonzero(mate >= 0)
    follows = np.zeros(len(mate), bool)
    follows[out] = mate[mate[out] ^ 1] >= 0
    to = np.arange(len(mate))
    to[follows] = mate[follows] ^ 1
    far = follows.astype(np.int64)
    for _ in range(len(mate).bit_length()):
        on = to[to]
        if (on == to).all():
            break
        far, to = far + far[to], on
    ring = follows[to]
    to[ring], far[ring] = np.flatnonzero(ring), 0
    first, back_first = mate[to[mate[out]]], mate[to[out]]
    # the direction of a whole walk: from the end that reads forward, else from the lesser node
    heads = np.unique(np.concatenate((first, back_first)) >> 1)
    rank = np.zeros(len(names), np.int64)
    rank[heads[pc.sort_indices(names.take(pa.array(heads))).to_numpy()]] = np.arange(len(heads))
    turned, other = 1 - (first & 1), 1 - (back_first & 1)
    held = (turned < other) | ((turned == other) & (rank[first >> 1] < rank[back_first >> 1]))
    out, first = out[held], first[held]
    before = far[mate[out]]
    size = before + far[out] + 1
    starts = before == 0
    # each link from the node that it leaves, and the last node of each fragment
    tail, head = mate[to[out[starts]]], first[starts]
    at = np.concatenate((out, tail))
    frag, p, k = np.concatenate((first, head)), np.concatenate((before, size[starts])), np.concatenate((size, size[starts]))
    forward = np.concatenate((out & 1, 1 - (tail & 1))) == 1
    nothing = np.full(len(tail), -1)
    ahead, behind = np.concatenate((link[out], nothing)), np.where(p > 0, link[np.concatenate((out ^ 1, tail))], -1)
    order = np.lexsort((p, frag))
    pick = lambda column, i: column.take(pa.array(i, mask=i < 0))
    ahead, behind = ahead[order], behind[order]
    columns = {
        "frag": pa.array(base | frag[order]), "p": pa.array(p[order]), "k": pa.array(k[order]), "head": names.take(pa.array(frag[order] >> 1)), "comp": names.take(pa.array(at[order] >> 1)),
        "orientation": pa.array(["-", "+"]).take(pa.array(forward[order].astype(np.int64))), "gap": pick(links["gap"], ahead), "dist": pick(links["dist"], ahead), "back": pick(links["gap"], behind), "back_dist": pick(links["dist"], behind),
    }
    return pa.table(columns)


def fragments(links: DataFrame, batch: int = LINKS) -> DataFrame:
    """(frag, p, k, head, comp, orientation, gap, dist, back, back_dist): the nodes of each fragment of k links, by their place p from 0 to k, with the gap
    ahead (null at the last) and behind (null at the first); ``head`` is the first node.

    ``links`` (gap, dist, a, aside, b, bside) meet a side of a node at most once. How links are dealt changes fragments, never walks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turn = 0

        def joined() -> Iterator[pa.RecordBatch]:
            base = (TaskContext.get().partitionId() << (_PORT_BITS + _BATCH_BITS)) | (turn << _PORT_BITS)
            yield from _joined(pa.Table.from_batches(held), base).to_batches(max_chunksize=1 << 16)

        for given in batches:
            for start in range(0, given.num_rows, batch):
                part = given.slice(start, batch)
                if held and sum(b.num_rows for b in held) + part.num_rows > batch:
                    yield from joined()
                    held, turn = [], turn + 1
                held.append(part)
        if sum(b.num_rows for b in held):
            yield from joined()

    kind = {f.name: f.dataType.simpleString() for f in links.schema}
    node, gap, dist = kind["a"], kind["gap"], kind["dist"]
    shape = f"frag long, p long, k long, head {node}, comp {node}, orientation string, gap {gap}, dist {dist}, back {gap}, back_dist {dist}"
    return links.select("gap", "dist", "a", "aside", "b", "bside").mapInArrow(run, shape)
