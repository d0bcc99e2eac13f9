"""Vector code compression: integer product quantisation whose assignments come from partial-distance search.

Components become integers floor(scale * x). Vectors are cut into ``parts`` equal consecutive parts, each with a codebook of
its own that starts as that part of the vectors of the smallest ids. A round assigns every part to the nearest entry and
replaces each entry by the floor of its parts' mean, component by component; entries without parts stay.

Partial-distance search: a part's dimensions are taken in descending variance over its codebook. Each row first gets one
complete distance, to the entry nearest in the leading dimension; then, entry by entry, squared differences are added up
one dimension at a time, and rows drop out of the mask once their sum strictly exceeds their best complete distance. Nothing that
could win or tie is dropped, so the result is that of full search.

A round is one pass over the vectors: a task adds up sums and counts for its rows (parts x entries numbers), Spark adds the
tasks' sums, and the driver divides; codebooks (parts x entries x dimensions numbers) are what it sends back. Vectors are read from the source,
their column alone, in each pass; nothing is written but the last pass.

Defined results: rows whose vector is null or holds null or non-finite components leave; shorter vectors count as padded with
zeros to the longest, and that to a multiple of ``parts``; components stop at 2**52 in size, errors at the ends of a long; a null id is
kept and is no seed, of rows of one id the least vector is the seed; fewer distinct ids than entries give fewer entries; ties go
to the lower entry; repeated rows are rows of their own; null labels are one label; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contigua.llm.common import shuffle_width, sized, stored

MOST = 1 << 52
#: Components up to this size are exact in longs for parts of up to 2**8 dimensions and 2**7 parts.
PLAIN = 1 << 23
LONG = np.iinfo(np.int64)
CHUNK = 8192


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in longs."""
    return np.clip(np.floor(flat.astype(float) * scale), -MOST, MOST).astype(np.int64)


def kept(column: pa.Array) -> np.ndarray:
    """Positions of the vectors that take part."""
    bad = ~np.isfinite(column.values.to_numpy(zero_copy_only=False).astype(float))  # nulls come as not-a-number
    rows = np.arange(len(column))
    if column.null_count:
        rows = rows[column.is_valid().to_numpy(zero_copy_only=False)]
    if bad.any():
        faults = np.concatenate(([0], np.cumsum(bad)))
        offsets = column.offsets.to_numpy()
        rows = rows[faults[offsets[rows + 1]] == faults[offsets[rows]]]
    return rows


def matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The vectors, which all take part, as rows of integers."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return whole(flat[offsets[0] : offsets[-1]].reshape(-1, dims), scale)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (a, n) in enumerate(zip(offsets[:-1], sizes)):
        out[i, :n] = whole(flat[a : a + n], scale)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors take part, some thousands at a time."""
    for batch in batches:
        rows = kept(batch.column(column))
        batch = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, differences computed) for each row of ``x``; integers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) > PLAIN:
        x, book = x.astype(object), book.astype(object)
    spread = (len(book) * (book * book).sum(0) - book.sum(0) ** 2).astype(float)  # variance, but for a factor
    order = np.argsort(-spread, kind="stable")
    columns = [np.ascontiguousarray(x[:, d]) for d in order]
    book = book[:, order]
    rows = np.arange(len(x))
    best = np.abs(columns[0][:, None] - book[None, :, 0]).argmin(1)
    least = sum((c - book[best, d]) ** 2 for d, c in enumerate(columns))
    work = len(x) * (len(book) + len(columns))
    for e in range(len(book)):
        live = rows[best != e]
        gone = np.zeros(len(live), x.dtype)
        for d, c in enumerate(columns):
            work += len(live)
            gone = gone + (c[live] - book[e, d]) ** 2
            stay = gone <= least[live]
            if not stay.all():
                live, gone = live[stay], gone[stay]
            if not len(live):
                break
        wins = (gone < least[live]) | (e < best[live])
        best[live[wins]], least[live[wins]] = e, gone[wins]
    return best, least, work


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts entries, distances summed over parts)."""
    size = books[0].shape[1]
    found = [nearest(x[:, p * size : (p + 1) * size], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), sum(f[1] for f in found)


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> list[np.ndarray]:
    """The codebooks, entries x dimensions each; none for an empty table."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if "double" in vectors.schema[vec_col].dataType.simpleString() else "array<float>").alias("vec"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's rows, the vectors of the smallest ids, or one vector where there are no ids; with the most dimensions of all."""
        held: dict[int | None, list[float]] = {}
        dims = -1
        for piece in _pieces(batches, 1):
            dims = max(dims, int(np.diff(piece.column(1).offsets.to_numpy()).max(initial=0)))
            ids = piece.column(0).to_pylist()
            some = sorted({i for i in ids if i is not None})[:entries]
            wanted = set(some) or {None}
            for at, i in enumerate(ids):
                if i in wanted:
                    vec = piece.column(1)[at].as_py()
                    held[i] = min(held.get(i, vec), vec)
            held = {i: held[i] for i in sorted((i for i in held if i is not None))[:entries]} or held
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64())), pa.array([dims] * len(held), pa.int32())], names=["id", "vec", "dims"])

    ahead = stored(own.mapInArrow(smallest, "id long, vec array<double>, dims int"))  # at most ``entries`` rows a task
    dims = ahead.agg(F.max("dims")).first()[0]
    if dims is None:
        return []
    size = max(1, -(-dims // parts))
    seeds = ahead.groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()  # ``entries`` rows
    seeds = [r for r in seeds if r.id is not None] or seeds[:1]
    first = matrix(pa.array([r.vec for r in seeds], pa.list_(pa.float64())), parts * size, scale)
    books = [first[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    names = [f"s{d}" for d in range(size)]

    def sums(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            n = len(books[0])
            total, count = np.zeros((parts, n, size), object), np.zeros((parts, n), np.int64)
            for piece in _pieces(batches, 0):
                x = matrix(piece.column(0), parts * size, scale)
                code, _ = _assigned(x, books)
                if np.abs(x).max() > PLAIN:
                    x = x.astype(object)
                for p in range(parts):
                    own = x[:, p * size : (p + 1) * size]
                    times = np.bincount(code[:, p], minlength=n)
                    order, there = np.argsort(code[:, p], kind="stable"), np.flatnonzero(times)
                    count[p] += times
                    total[p, there] += np.add.reduceat(own[order], np.searchsorted(code[order, p], there), axis=0)
            p, e = np.nonzero(count)
            columns = [pa.array([str(v) for v in total[p, e, d]]) for d in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *columns], names=["part", "entry", "n", *names])

        return run

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        found = own.select("vec").mapInArrow(sums(sent), "part int, entry int, n long, " + ", ".join(f"{s} string" for s in names))
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names))
        books = [b.copy() for b in books]
        for r in found.collect():  # parts x entries rows
            books[r.part][r.entry] = [int(r[s]) // r.n for s in names]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error): two hexadecimal digits a part, and the squared distance to what the code stands for."""
    schema = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias(label_col)).schema.add("code", "string").add("error", "long")
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    sent, dims = vectors.sparkSession.sparkContext.broadcast(books), sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 2):
            code, error = _assigned(matrix(piece.column(2), dims, scale), sent.value)
            if error.dtype == object:
                error = np.array([min(v, LONG.max) for v in error], np.int64)
            digits = pa.array([row.tobytes().hex() for row in code.astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), digits, pa.array(error)], names=[id_col, label_col, "code", "error"])

    own = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias(label_col), F.col(vec_col).alias("__vec"))
    return own.mapInArrow(run, schema)


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """With the error summed over the rows of each label; a label of a ``shuffle_width``-th of all rows or more is joined by broadcast (there are at most as many)."""
    spark = codes.sparkSession
    codes = stored(codes)
    keys = [F.col(label_col).isNull().alias("__none"), F.col(label_col).cast("string").alias("__label")]
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    summed = stored(codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.least(total, F.lit(LONG.max).cast("decimal(38,0)")).cast("long").alias("label_error")))
    same = (F.col(label_col).isNull() == F.col("__none")) & (F.coalesce(F.col(label_col).cast("string"), F.lit("")) == F.coalesce("__label", F.lit("")))
    small = sized(summed, 64)
    if small is not summed:
        return codes.join(small, same).drop("__none", "__label", "__n")
    hot = F.col("__n") * shuffle_width(spark) >= codes.count()
    often = F.broadcast(summed.filter(hot))
    rest = codes.join(often, same, "left_anti").join(summed.filter(~hot), same)
    return codes.join(often, same).unionByName(rest).drop("__none", "__label", "__n")
