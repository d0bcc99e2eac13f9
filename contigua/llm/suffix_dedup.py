"""Repeated passages by sparse suffix arrays.

Suffixes start only at minimisers: of every ``w`` consecutive k-word windows that with the least hash.
With w + k - 1 = ``least_words``, two documents that share a passage of that length retain the same
suffix inside it.

0. Large groups of documents of equal text (more than MANY, and more than one in SHARE of all, so that at most SHARE groups are
   told to all tasks) are one document from here on; of ``least_words`` words or more, each copy is a passage as a whole.
1. First pass: per hash of a retained suffix's first k words, the documents that hold it and the rows that it would give.
2. Those of at least two documents are marked in a bit table, and of these those of more than ``run_rows`` rows in another.
   Tables have 16 bits a hash, up to 2**MOST_BITS bits (32 MB each). Fuller ones let more suffixes through; none is lost.
3. Second pass: suffixes that may have a partner leave with up to ``least_words`` words on either side; those of a document
   with equal words on both sides are one row with all their positions, whatever the distance between them.
   They are sorted by text. Within a run of equal first k words each suffix is compared with its
   nearest neighbour for every length of common left context, so the best match in words to the left
   plus words to the right is found without comparing all pairs; the match is extended both ways.
4. Stretches of one document that overlap are merged. Retained suffixes are less than
   ``least_words`` apart, so the union is the whole passage, however long.

Skew: no run has more than ``run_rows`` rows. Suffixes of more are not compared: every window of ``least_words`` words
around one leaves as its hash and positions, and hashes that two documents have are passages.
A passage of that length or more is the union of its windows, each holds a retained suffix, and the windows
of a suffix marked so are all looked at, so nothing is shortened; grouping by hash needs no run in memory.

Defined results: passages are verbatim runs of white-space-separated words; documents are told apart by id and text, so rows
with null or equal ids are documents of their own, and rows equal in both are one (and given once); a passage repeated
only inside one document is none; null and short texts have none; an empty table gives an empty result; other
columns are ignored. Texts are read whole, a stretch of bytes at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from contigua.llm.common import give_back, row_key, shuffle_width, stored
from contigua.llm.mixing import word_count

MOST_BITS = 28
POSITION_BITS = 24
STRETCH = 4 << 20  # bytes of a text handled at once
ROW_BYTES = 8 << 20  # suffix rows held before they leave
FEW = 6  # rows of a run that are compared pair by pair
#: Groups of equal texts of more than so many documents, and of more than this share of all, count as one document.
MANY, SHARE = 1000, 100_000


def minimisers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some ``w`` neighbours; of equal ones the first."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    at = least & mask
    return np.unique(at[np.concatenate(([True], at[1:] != at[:-1]))]).astype(np.int64)


def stretches(text: bytes, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, number of the first): a text of any length in pieces that share ``overlap`` words."""
    at, first, tail = 0, 0, []
    while at < len(text) or not at:
        end = at + STRETCH
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        words = tail + text[at:end].split()
        yield words, first
        tail = words[-overlap:] if overlap else []
        first += len(words) - len(tail)
        at = max(end, 1)


@dataclass
class Stretch:
    """A piece of a text: its words, the number of the first, the words joined by blanks with where each begins and ends,
    and the retained suffixes' positions and hashes."""

    words: list[bytes]
    first: int
    line: bytes
    begins: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    h: np.ndarray


def retained(text: bytes | None, k: int, w: int) -> Iterator[Stretch]:
    for words, first in stretches(text or b"", w + k - 2):
        if len(words) < w + k - 1:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        hashes = window_hashes(words, k)
        at = minimisers(hashes, w)
        yield Stretch(words, first, line, begins, ends, at, hashes[at])


def window_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Of every k words in a row: a polynomial of the words' hashes, mixed."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = own[: len(own) - k + 1].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += own[i : len(own) - k + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sides(s: Stretch, w: int, least_words: int, at: np.ndarray) -> list[bytes]:
    """Per suffix a digest of all its words on either side and of how far they reach."""
    left, right = np.maximum(at - w + 1, 0), np.minimum(at + least_words, len(s.words))
    digest = xxhash.xxh128_digest
    return [digest(s.line[a:b], n) for a, b, n in zip(s.begins[left].tolist(), s.ends[right - 1].tolist(), (at - left).tolist())]


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def match_run(run: list[tuple[object, list[bytes], list[bytes]]], least_words: int) -> dict[int, list[int]]:
    """Row number: words to the left and to the right that it shares with others; for a run of suffixes (document, words
    before, nearest first; words from it), sorted by the latter.

    For each length of common left context, the best partner is the nearest suffix of another document before
    or behind in the order; both are looked at.
    """
    best: dict[int, list[int]] = {}
    if len(run) <= FEW:  # the same, pair by pair
        for j, (doc, before, after) in enumerate(run):
            for i in range(j):
                if run[i][0] != doc:
                    right = _common(after, run[i][2])
                    left = _common(before, run[i][1]) if right else 0
                    if right and left + right >= least_words:
                        for x in (i, j):
                            own = best.setdefault(x, [0, 0])
                            own[0], own[1] = max(own[0], left), max(own[1], right)
        return best
    keys = []
    for _, before, _ in run:
        own = array("q", [0])
        for word in before:
            own.append(hash((own[-1], word)))
        keys.append(own)
    for order in (range(len(run)), range(len(run) - 1, -1, -1)):
        last: dict[int, tuple[int, int | None]] = {}  # by hash of the words before: the nearest, and the nearest of another document than its
        for i in order:
            doc, _, after = run[i]
            full = False
            for left in range(len(keys[i]) - 1, -1, -1):
                key = keys[i][left]
                held = last.get(key)
                if held is None:
                    last[key] = (i, None)
                    continue
                same = run[held[0]][0] == doc
                j = held[1] if same else held[0]
                if j is not None and not full:
                    right = _common(after, run[j][2])
                    if left + right >= least_words:
                        own = best.setdefault(i, [0, 0])
                        own[0], own[1] = max(own[0], left), max(own[1], right)
                        full = right >= len(after)
                last[key] = (i, held[1] if same else held[0])
    return best


def bit_table(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A table with the bits of column ``h`` set, of 16 bits a row, at most 2**most_bits; at most 2**(most_bits - 6) rows
    reach the driver."""
    bits = min(most_bits, max(12, (16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(table) * 64 - 1)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def repeated_passages(docs: DataFrame, least_words: int = 50, k: int = 8, run_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word_start, word_end``: the maximal stretches of a document that other documents hold too."""
    spark = docs.sparkSession
    w = least_words - k + 1
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).filter("text IS NOT NULL").select("doc_id", "text", *row_key(F.col("text")))
    groups = named.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id")).alias("first"))
    least = max(MANY, named.count() // SHARE)
    copies = F.broadcast(stored(groups.filter(F.col("n") > least).select("k1", "k2", F.col("first.doc_id").alias("first"), F.lit(True).alias("copied"))))  # at most SHARE rows
    marked = named.join(copies, ["k1", "k2"], "left")
    rows = marked.filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", F.col("k1").alias("key"), F.col("text").cast("binary").alias("text"))
    whole = marked.filter("copied").select("doc_id", "k1", word_count(F.col("text")).alias("word_end")).distinct()
    whole = stored(whole.filter(F.col("word_end") >= least_words))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            rows_of: list[np.ndarray] = []
            for text in batch.column(0):
                seen = [(s.h, np.frombuffer(b"".join(sides(s, w, least_words, s.at)), np.uint64)[::2]) for s in retained(text.as_py(), k, w)]
                if seen:
                    h, side = (np.concatenate(c) for c in zip(*seen))
                    h, n = np.unique(h[np.unique(h * np.uint64(0x9E3779B97F4A7C15) ^ side, return_index=True)[1]], return_counts=True)
                    held.append(h)
                    rows_of.append(n)
            h, at, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
            total = np.bincount(at, np.concatenate(rows_of)).astype(np.int64) if held else n
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(total.astype(np.int64))], names=["h", "docs", "n"])
        give_back()

    counted = rows.select("text").mapInArrow(first_pass, "h long, docs long, n long").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counted = stored(counted.filter("docs > 1").select("h", "n"))
    hot = counted.filter(F.col("n") > run_rows)
    any_hot = not hot.isEmpty()
    tables = spark.sparkContext.broadcast((bit_table(counted), bit_table(hot)))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent = tables.value
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc, key = doc.as_py(), key.as_py()
                place: dict[tuple[int, bytes], list[int]] = {}
                for s in retained(text.as_py(), k, w):
                    often = in_table(frequent, s.h)
                    if often.any():
                        yield from windows_of(doc, key, s, s.at[often])
                    keep = in_table(known, s.h) & ~often
                    at = s.at[keep]
                    for p, x, side in zip(at.tolist(), s.h[keep].view(np.int64).tolist(), sides(s, w, least_words, at)):
                        where = place.get((x, side))
                        if where is None:
                            where = place[x, side] = []
                            out.append((x, doc, key, where, b" ".join(s.words[max(0, p - w + 1) : p][::-1]), b" ".join(s.words[p : p + least_words]), None))
                            size += len(out[-1][4]) + len(out[-1][5]) + 100
                        where.append(s.first + p)
                        size += 8
                    if size > ROW_BYTES:
                        yield suffix_batch(out)
                        out, size, place = [], 0, {}
            yield suffix_batch(out)
        give_back()

    def windows_of(doc: int | None, key: int, s: Stretch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All windows around frequent suffixes: their hashes and where they begin."""
        digest = xxhash.xxh128_digest
        starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + least_words <= len(s.words))]
        for some in np.array_split(starts, -(-len(starts) // 65_536)):
            keys = np.frombuffer(b"".join(digest(s.line[a:b]) for a, b in zip(s.begins[some].tolist(), s.ends[some + least_words - 1].tolist())), np.int64).reshape(-1, 2)
            order = np.lexsort((some, keys[:, 1], keys[:, 0]))
            keys, places = keys[order], some[order] + s.first
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(keys)), pa.int32()), pa.array(places))
            n = len(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys[new, 0]), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), lists, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(keys[new, 1])], names=names)

    names = ["h", "doc_id", "key", "at", "before", "after", "y"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]

    def suffix_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_held, run, where, words = None, [], [], {}
        share = lambda text: [words.setdefault(x, x) for x in text.split()]  # noqa: E731  (a run's rows hold the same words)
        out: list[tuple] = []

        def end_run() -> None:
            if len(run) > 1:
                for i, (left, right) in match_run(run, least_words).items():
                    (doc, key) = run[i][0]
                    out.extend((doc, key, p - left, p + right) for p in where[i])
            run.clear(), where.clear(), words.clear()

        def spans() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 4], names=["doc_id", "key", "word_start", "word_end"])

        for batch in batches:
            for h, doc, key, at, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                if h != h_held:
                    end_run()
                    h_held = h
                run.append(((doc, key), share(before), share(after)))
                where.append(at)
                if len(out) > 50_000:
                    yield spans()
                    out.clear()
        end_run()
        yield spans()
        out.clear()
        give_back()

    schema = "doc_id long, key long, word_start long, word_end long"
    left = rows.mapInArrow(second_pass, "h long, doc_id long, key long, at array<long>, before binary, after binary, y long")
    if any_hot:
        left = stored(left)
    ordered = left.filter("after IS NOT NULL").drop("y").repartition(shuffle_width(spark), "h").sortWithinPartitions("h", "after", "doc_id", "key")
    found = ordered.mapInArrow(compare, schema)
    if any_hot:
        windows, doc = left.filter("after IS NULL").select("h", "y", "doc_id", "key", "at"), F.struct("doc_id", "key")
        shared = windows.groupBy("h", "y").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).filter("least <> most").select("h", "y")
        spans = windows.join(shared, ["h", "y"], "left_semi").select("doc_id", "key", F.explode("at").alias("word_start"))
        found = found.union(spans.select("doc_id", "key", "word_start", (F.col("word_start") + least_words).alias("word_end")))
    by_start = Window.partitionBy("doc_id", "key").orderBy("word_start", "word_end")
    reach = F.max("word_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach") >= F.col("word_start"), 0).otherwise(1)).over(by_start))
    passages = merged.groupBy("doc_id", "key", "island").agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))
    copied = whole.select(F.col("doc_id").alias("c"), F.col("k1").alias("ck"))
    rest = passages.join(copied, F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("ck")), "left_anti")
    return rest.select("doc_id", "word_start", "word_end").union(whole.select("doc_id", F.lit(0).cast("long").alias("word_start"), "word_end"))
