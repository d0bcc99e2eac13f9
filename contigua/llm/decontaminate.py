"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

An item is contained in a document if some window of the item's size has a weighted (multiset) Jaccard
similarity of word shingles of at least ``threshold`` with it.

1. Windows. A window can only reach the threshold if it holds at least threshold / (1 + threshold) times
   (its shingles + the item's) shingles that occur in the benchmark at all; shingles are tested against
   a bit table, and prefix sums give every window, of every item size, that passes. This
   loses nothing, and a clean document has none.
2. SimHash of each such window from prefix sums of its shingles' bits.
3. Multi-index: a fingerprint is cut in ``radius + 1`` blocks; two within the radius agree in one of
   them, so block tables of the items of that size give all within the radius. No other way leads to a candidate.
4. Candidates are verified by their exact weighted shingle counts; per document and item the best
   windows that do not overlap are returned.

The benchmark is taken in chunks of about ``chunk_bytes`` of text by hash of id and text (what is built of one, some ten times as
much, is sent to the executors); each chunk is one pass over the documents. Windows are taken a piece at a time. A passage that many documents hold costs each of them
the same; nothing is grouped by passage.

What the method cannot promise: SimHash distance is random. With 64 bits and radius 18, a window of
similarity 0.8 lies outside with probability 0.002 (mean 9.7, deviation 2.9), and far less above it.

Defined results: words are runs of letters, digits and non-ASCII bytes after lower-casing; an item with fewer words than a
shingle is sought word for word (similarity 1, distance 0); items without words match nothing; null texts
match nothing; a null item id stays null; repeated items are returned each; an empty table gives an empty
result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from contigua.llm.common import sized, stored
from contigua.llm.simhash import distance

FILTER_BITS = 20
PIECE = 1 << 16  # windows of a text that are looked at together
_KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
OUT = "doc_id long, item_id long, similarity double, word_start long, n_words long, hamming int"


def shingle_hashes(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    """(hashes in order, words)."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEPT).split()
    if not words:
        return np.zeros(0, np.uint64), 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line)], np.uint64), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.array([digest(line[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64), len(words)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums of +1/-1 for the 64 bits: row i is the sum of the first i hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(ones, axis=0, dtype=np.int32)])


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class BlockIndex:
    """Fingerprints by the values of their blocks; finds all within the radius, for many queries at once."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            at, mask = np.uint64(a), np.uint64((1 << (b - a)) - 1)
            values = (fps >> at) & mask
            order = np.argsort(values, kind="stable")
            self.blocks.append((at, mask, order, np.searchsorted(values[order], np.arange((1 << (b - a)) + 1, dtype=np.uint64))))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, distance) of all pairs within the radius: those that agree in some block, checked."""
        most = max(1, (1 << 22) // max(1, len(self.fps)))
        if len(queries) > most:  # bounded memory
            parts = [self.near(queries[a : a + most]) for a in range(0, len(queries), most)]
            return np.concatenate([p[0] + a * most for a, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        pairs = []
        for at, mask, order, edges in self.blocks:
            v = ((queries >> at) & mask).astype(np.int64)
            n = edges[v + 1] - edges[v]
            q = np.repeat(np.arange(len(queries)), n)
            place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + edges[v][q]
            pairs.append(q * len(self.fps) + order[place])
        q, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.fps))
        d = distance(self.fps[i], queries[q])
        close = d <= self.radius
        return q[close], i[close], d[close]


class Benchmark:
    """What the executors need of a chunk of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int, radius: int):
        self.shingle = shingle
        self.ids, self.counts, sizes, fps = [], [], [], []
        self.short: dict[int, dict[int, list[int | None]]] = defaultdict(lambda: defaultdict(list))  # by words: by hash: items
        for item, text in items:
            hashes, words = shingle_hashes(text, shingle)
            if 0 < words < shingle:
                self.short[words][int(hashes[0])].append(item)
            elif words:
                self.ids.append(item)
                self.counts.append(np.unique(hashes, return_counts=True))
                sizes.append((words, len(hashes)))
                fps.append(packed(bit_sums(hashes)[-1:])[0])
        self.short = {n: dict(own) for n, own in self.short.items()}
        self.known = np.unique(np.concatenate([c[0] for c in self.counts])) if self.counts else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self.known & np.uint64((1 << FILTER_BITS) - 1)] = True
        by_size = defaultdict(list)
        for i, s in enumerate(sizes):
            by_size[s].append(i)
        self.by_size = {s: (x, BlockIndex(np.array([fps[i] for i in x], np.uint64), radius)) for s, x in by_size.items()}
        self.most = max((m for _, m in by_size), default=0)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[hashes & np.uint64((1 << FILTER_BITS) - 1)])
        if not len(maybe):
            return maybe
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        return maybe[self.known[place] == hashes[maybe]]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (distinct hashes in order, counts)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def best_apart(windows: list[tuple[float, int, int, int]]) -> Iterator[tuple[float, int, int, int]]:
    """Of windows (-similarity, distance, first word, words) the best, then the best that overlaps none before, and so on."""
    starts: list[int] = []
    ends: list[int] = []
    for window in sorted(windows):
        start, end = window[2], window[2] + window[3]
        i = bisect(starts, start)
        if (i == 0 or ends[i - 1] <= start) and (i == len(starts) or starts[i] >= end):
            starts.insert(i, start)
            ends.insert(i, end)
            yield window


def find_items(text: str | None, bench: Benchmark, threshold: float) -> Iterator[tuple[int | None, float, int, int, int]]:
    """(item, similarity, first word, words, Hamming distance) of the items that a text contains."""
    hashes, words = shingle_hashes(text, bench.shingle)
    for n, known in bench.short.items():
        for at, h in enumerate(shingle_hashes(text, n)[0].tolist() if words >= n else ()):
            for item in known.get(h, ()):
                yield item, 1.0, at, n, 0
    hit = bench.hits(hashes)
    if not len(hit):
        return
    found: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)
    groups = np.split(hit, np.flatnonzero(np.diff(hit) > bench.most) + 1)  # stretches that no window spans
    for group in groups:
        low, high = max(0, int(group[0]) - bench.most), min(len(hashes), int(group[-1]) + bench.most + 1)
        for piece in range(low, high, PIECE):
            end = min(high, piece + PIECE)
            own = hashes[piece : min(high, end + bench.most)]
            mark = np.zeros(len(own) + 1, np.int64)
            inside = group[(group >= piece) & (group < piece + len(own))]
            mark[inside - piece + 1] = 1
            upto = np.cumsum(mark)
            sums = None
            for (n_words, m), (items, index) in bench.by_size.items():
                w = min(m, len(own)) if piece == low else m  # a text shorter than the item is one window
                if w > len(own):
                    continue
                need = ceil(threshold / (1 + threshold) * (w + m) - 1e-9)
                starts = np.flatnonzero(upto[w:] - upto[:-w] >= need)
                starts = starts[starts < end - piece]
                if not len(starts):
                    continue
                sums = bit_sums(own) if sums is None else sums
                last, held = -1, None
                for q, i, d in zip(*(x.tolist() for x in index.near(packed(sums[starts + w] - sums[starts])))):
                    at = int(starts[q])
                    if q != last:
                        last, held = q, np.unique(own[at : at + w], return_counts=True)
                    s = similarity(held, bench.counts[items[i]])
                    if s >= threshold:
                        found[items[i]].append((-s, d, piece + at, min(n_words, words - piece - at)))
    for i, windows in found.items():
        for s, d, start, n in best_apart(windows):
            yield bench.ids[i], -s, start, n, d


def contaminations(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 18, chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, word_start, n_words, hamming``: a row for each contained item and place."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks = max(1, -(-2 * total // chunk_bytes)) if total > chunk_bytes else 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passes = []
    for c in range(n_chunks):
        chunk = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_chunks)) == c) if n_chunks > 1 else items
        sent = spark.sparkContext.broadcast(Benchmark([(r.item, r.text) for r in chunk.collect()], shingle, radius))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for batch in batches:
                out = [(doc.as_py(), *hit) for doc, text in zip(batch.column(0), batch.column(1)) for hit in find_items(text.as_py(), bench, threshold)]
                columns = list(zip(*out)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "similarity", "word_start", "n_words", "hamming"])

        passes.append(rows.mapInArrow(run, OUT))
    return reduce(DataFrame.union, passes)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text is not contaminated; rows are told apart by the hash of the text, so ids may be null or repeated."""
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    options["id_col"] = "__mark"
    bad = contaminations(docs.select(mark.alias("__mark"), text_col), benchmark, text_col=text_col, **options)
    bad = sized(stored(bad.select(F.col("doc_id").alias("__bad")).distinct()), 8)
    return docs.withColumn("__mark", mark).join(bad, F.col("__mark") == F.col("__bad"), "left_anti").select(*docs.columns)
