"""Exact top-k by inner product as a Voronoi join: pivots, bounds from cell summaries, local solving.

1. Components become integers floor(scale * x); rows that are null or hold null or non-finite
   components leave, and of rows of equal id all but one. Shorter vectors count as padded with zeros.
2. Pivots are a bounded, hash-ordered sample of the rows; every row goes to its nearest pivot's cell.
3. A summary of each cell (rows, radius, largest norm) reaches the driver: one row a pivot.
4. For a query q, the k-th best of its scores with the pivots, and of the cells' lower bounds
   q.p - |q| r, is a floor that its answer reaches. A cell is needed only if its upper bound
   min(q.p + |q| r, |q| max|x|) reaches that floor; the query is sent to those cells alone. The queries
   are the smaller side, so they are what is replicated, never the data.
5. A cell is cut into chunks of about ``chunk_rows`` by hash of the id, so a cell that holds a third of
   all rows is many tasks; chunks are solved as matrix products, exact in doubles below 2**53 and
   in Python integers beyond; the chunks' best k are ranked per query.

Defined results: ties go to the smaller id; a query never meets a row of its own id; repeated rows (equal
id) count once; rows without an id leave; scores beyond a long stop at its ends; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.llm.common import cut

LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (a, n) in enumerate(zip(offsets[:-1], sizes)):
        out[i, :n] = flat[a : a + n]
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond a long they stop at its ends."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    if float(np.abs(queries.astype(float)).max()) * float(np.abs(data.astype(float)).max()) * queries.shape[1] < 2**53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ data.astype(object).T
    return np.vectorize(lambda v: min(max(v, LONG.min), LONG.max), otypes=[np.int64])(exact)


def best_k(found: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query position, positions of its k best) for ids in ascending order."""
    for i in range(len(found)):
        row = found[i]
        keep = np.flatnonzero(ids != own[i])
        if len(keep) > k:
            least = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= least]
        yield i, keep[np.lexsort((keep, -row[keep]))][:k]


def knn_join(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, most_pivots: int = 1024, chunk_rows: int = 4096
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. ``is_query`` may use ``id``."""
    spark = vectors.sparkSession
    vecs = cut(quantised(vectors, id_col, vec_col, scale).dropDuplicates(["id"]))  # pivots and cells count ids, not rows
    n, dims, n_queries = vecs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out)
    dims = max(dims, 1)
    n_pivots = min(most_pivots, max(16, isqrt(n) // 4))
    sample = vecs.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    p_ids, p_vecs = np.array([r.id for r in sample], np.int64), np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        p_vecs[i, : len(r.vec)] = r.vec
    pivots = spark.sparkContext.broadcast((p_ids, p_vecs))  # at most most_pivots rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value[1]
        for batch in batches:
            m = _matrix(batch.column(1), dims)
            x = m.astype(float)
            norms = (x * x).sum(1)
            cell = (norms[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :]).argmin(1)
            away = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt(norms)), pa.array([v.tobytes() for v in m], pa.binary())],
                names=["id", "cell", "away", "norm", "vec"],
            )

    placed = cut(vecs.mapInArrow(assign, "id long, cell int, away double, norm double, vec binary"))
    radius, longest, held = np.zeros(len(sample)), np.zeros(len(sample)), np.zeros(len(sample), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.max("norm").alias("m")).collect():
        radius[r.cell], longest[r.cell], held[r.cell] = r.r, r.m, r.n
    chunks = -(-held // chunk_rows)
    summary = spark.sparkContext.broadcast((radius, longest, held, chunks))
    q_chunks = -(-int(n_queries) // 1024)

    def mixed(ids: np.ndarray) -> np.ndarray:
        h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(3)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            chunk = mixed(ids) % summary.value[3][cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(chunk.astype(np.int32)), batch.column(0), batch.column(4)], names=["cell", "chunk", "id", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p_id, p), (r, m, held, chunks) = pivots.value, summary.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            group = mixed(ids) % np.uint64(q_chunks)
            for i, (q_id, raw) in enumerate(zip(ids.tolist(), batch.column(4).to_pylist())):
                q = np.frombuffer(raw, np.int64).astype(float)
                size = float(np.sqrt(q @ q))
                dot = p @ q
                slack = 1e-9 * (np.abs(dot) + size * r + 1)
                real = np.sort(dot[p_id != q_id])[::-1]
                floor = real[k - 1] if len(real) >= k else -np.inf
                low, count = dot - size * r - slack, held - 1  # its own row may be one of the cell's
                order = np.argsort(-low)
                enough = np.flatnonzero(np.cumsum(np.maximum(count[order], 0)) >= k)
                floor = max(floor, low[order[enough[0]]] if len(enough) else -np.inf)
                need = np.flatnonzero((held > 0) & (np.minimum(dot + size * r, size * m) + slack >= floor))
                cells = np.repeat(need, chunks[need])
                parts = np.concatenate([np.arange(c) for c in chunks[need]]) if len(need) else cells
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.astype(np.int32)), pa.array(parts.astype(np.int32)), pa.array(np.full(len(cells), int(group[i]), np.int32)), pa.array(np.full(len(cells), q_id)), pa.array([raw] * len(cells), pa.binary())],
                    names=["cell", "chunk", "part", "id", "vec"],
                )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        first = {c: [pdf[c].iloc[0]] for c in ("cell", "chunk", "part") if c in pdf}
        return pd.DataFrame(first | {"ids": [pdf["id"].to_numpy().tobytes()], "vecs": [b"".join(pdf["vec"])]})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vecs, d_ids, d_vecs in zip(*(batch.column(i) for i in range(4))):
                qi, di = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(d_ids.as_py(), np.int64)
                q, d = np.frombuffer(q_vecs.as_py(), np.int64).reshape(-1, dims), np.frombuffer(d_vecs.as_py(), np.int64).reshape(-1, dims)
                for at in range(0, len(qi), 128):
                    own = qi[at : at + 128]
                    s = scores(q[at : at + 128], d)
                    rows = [(np.full(len(best), own[i]), di[best], s[i][best]) for i, best in best_k(s, di, own, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    data = placed.mapInArrow(deal, "cell int, chunk int, id long, vec binary").groupBy("cell", "chunk").applyInPandas(pack, "cell int, chunk int, ids binary, vecs binary")
    asked = placed.filter(is_query).mapInArrow(visit, "cell int, chunk int, part int, id long, vec binary").groupBy("cell", "chunk", "part").applyInPandas(pack, "cell int, chunk int, part int, ids binary, vecs binary")
    pairs = asked.select("cell", "chunk", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")).join(data, ["cell", "chunk"])
    found = pairs.select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(solve, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
