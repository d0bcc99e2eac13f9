"""Best-fit packing by patterns of lengths: non-negative least squares over a histogram, then placing by rank.

1. A document's token ids, with a closing id, are cut into pieces of at most ``limit`` ids (only longer documents are cut).
2. The histogram of piece lengths, at most ``limit`` numbers whatever the input, reaches the driver.
3. Patterns of few documents (at most three lengths, at most five pieces) that fill a sequence to the last token are
   enumerated; for each length the ``per_length`` ones stay that the histogram could repeat most often.
4. Their repeat counts x >= 0 are fitted to the histogram h by least squares, min |Ax - h|, with accelerated projected gradients
   (A has three entries a column, so a step costs a few thousand additions), rounded, and lowered where pieces would run out.
5. What the patterns leave is packed by best fit, longest first, on the histogram: equal lengths in equal bins are one step, so
   the work follows the number of lengths, not of pieces.
6. All patterns together are a table of runs (length, first rank, copies a sequence, first sequence, offset), some
   thousands of rows by construction. A piece's rank among those of its length, counted inside its partition and
   carried over partitions by a window over (length, partition) counts, picks its run, hence its sequence and offset.

No piece meets another in a task, so a length that holds a third of all pieces is as many tasks as its rows are.

Defined results: a null or empty text is the closing id alone; a text of any length is read whole; repeated rows are pieces of
their own; equal lengths are interchangeable, and which of them goes where depends on the order of the files only; a null id
is passed on; an empty table gives an empty result; further columns are ignored (``cut_documents``) or passed on (``pack``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from contigua.llm.common import stored
from contigua.llm.token_counts import MergeCounter, folded

#: Chunks and words that a worker remembers, and the longest of them; only speed depends on it.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: (copies of the first length, copies of the second), beside one piece of a third or none.
COPIES = ((1, 1), (2, 1), (1, 2), (3, 1), (1, 3), (2, 2), (4, 1), (1, 4))

_IDS: dict[int, "TokenIds"] = {}


class _Table(dict):
    """Key -> what ``make`` gives for it. When full, it becomes the older table, from which what is still asked for comes back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key) or self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TokenIds:
    """The library's ids of a text as little-endian 32-bit numbers.

    The library merges each word once; the words of a text are split off as its own pre-tokenizer does, and looked up.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.rules = MergeCounter(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.visible = {b: ord(c) for b, c in enumerate(self.rules.symbols)}
        self.chunks = _Table(self._chunk)

    def _word(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable():
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.visible)
        found = self.model.tokenize(word)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        body = chunk[:-1]
        if body.isalpha():  # a mark or digit behind a word
            return self.chunks[body] + self.chunks[chunk[-1]]
        return self._words(chunk)

    def _words(self, chunk: str) -> bytes:
        return b"".join([self.chunks[w] if w.isalpha() else self._word(w) for w in self.rules.words.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        text = folded(text)
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to str.split, not to the pattern
            return self._words(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        rules = self.rules
        if not any(s in text for s in rules.special_hint):
            return self._plain(text)
        out, at = [], 0
        for hit in rules.special.finditer(text):
            out += [self._plain(text[at : hit.start()]), struct.pack("<I", self.tokenizer.token_to_id(hit.group()))]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])


def ids_for(spec: str) -> TokenIds:
    key = hash(spec)
    if key not in _IDS:
        _IDS[key] = TokenIds(spec)
    return _IDS[key]


def cut_documents(docs: DataFrame, vocabulary: str, limit: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and the closing one, in pieces; ``ids`` are little-endian 32-bit numbers.

    ``vocabulary`` is the path of the tokenizer's JSON file on the driver; it is sent to the executors once (1.7 MB for the 49k one).
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = struct.pack("<I", closing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ids_for(spec.value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [id_col, "piece", "start", "length", "ids"]
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = tokens.ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(whole), 4 * limit)):
                    own = whole[at : at + 4 * limit]
                    rows.append((doc, piece, at // 4, len(own) // 4, own))
                    held += len(own)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    own = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids binary")


# -- the plan, on the histogram -----------------------------------------------------------------------


def patterns(lengths: np.ndarray, counts: np.ndarray, limit: int, per_length: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(places, copies), each patterns x 3: positions in ``lengths`` (-1: none) and how often they occur; each sums to ``limit``."""
    place = np.full(limit + 1, -1)
    place[lengths] = np.arange(len(lengths))
    found: list[np.ndarray] = []
    for i, a in enumerate(lengths.tolist()):
        if limit % a == 0 and limit // a <= 5:
            found.append(np.array([[i, -1, -1, limit // a, 0, 0]]))
        rows, scores = [], []
        for k, m in COPIES:
            rest = limit - k * a - m * lengths
            j = np.flatnonzero((rest >= 0) & (lengths < a))
            j = j[(rest[j] == 0) | (place[rest[j]] >= 0)] if len(j) else j
            if not len(j):
                continue
            c = np.where(rest[j] == 0, -1, place[rest[j]])
            j, c = (x[(c < 0) | ((c != i) & (c != j))] for x in (j, c))
            score = np.minimum(counts[i] // k, counts[j] // m)
            score = np.where(c < 0, score, np.minimum(score, counts[c]))
            rows.append(np.stack([np.full(len(j), i), j, c, np.full(len(j), k), np.full(len(j), m), (c >= 0).astype(int)], 1))
            scores.append(score)
        if rows:
            rows, scores = np.concatenate(rows), np.concatenate(scores)
            found.append(rows[np.argsort(-scores, kind="stable")[:per_length]])
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 6), int)
    return every[:, :3], every[:, 3:]


def least_squares(places: np.ndarray, copies: np.ndarray, counts: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with Ax near ``counts``, column j of A holding ``copies[j]`` at ``places[j]``: accelerated projected gradients."""
    if not len(places):
        return np.zeros(0)
    n, at, weight = len(counts), np.where(places < 0, 0, places), np.where(places < 0, 0, copies).astype(float)
    times = lambda x: np.bincount(at.ravel(), (weight * x[:, None]).ravel(), n)
    back = lambda r: (weight * r[at]).sum(1)
    v = np.ones(len(places))
    for _ in range(30):  # the largest eigenvalue of A'A, by powers
        v = back(times(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.05 * size)
    x = y = np.zeros(len(places))
    t, h = 1.0, counts.astype(float)
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - h))
        if (new - x) @ (y - new) > 0:  # momentum points uphill: begin it anew
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def rounded(x: np.ndarray, places: np.ndarray, copies: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, counts left): x to whole repeats, the most repeated first, never more than pieces are left; then one more where it was cut."""
    left = counts.astype(np.int64).copy()
    repeats = np.zeros(len(x), np.int64)
    for wanted in (np.floor(x).astype(np.int64), (x - np.floor(x) >= 0.5).astype(np.int64)):
        for j in np.argsort(-x, kind="stable").tolist():
            if wanted[j]:
                used = places[j] >= 0
                t = min(int(wanted[j]), int((left[places[j][used]] // copies[j][used]).min()))
                repeats[j] += t
                left[places[j][used]] -= t * copies[j][used]
    return repeats, left


def best_fit(lengths: list[int], counts: list[int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, copies) pairs, repeats)]: best fit, longest first, for all pieces of a length at once."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # room left -> bins
    done = []

    def put(pattern, repeats, room):
        open_.setdefault(room, []).append((pattern, repeats))

    for length, n in sorted(zip(lengths, counts), reverse=True):
        rooms = sorted(r for r in open_ if r >= length)
        for room in rooms:
            each = room // length
            while n and room in open_:
                pattern, repeats = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                t = min(repeats, n // each)
                if t:
                    put([*pattern, (length, each)], t, room - each * length)
                    n -= t * each
                    repeats -= t
                if repeats and 0 < n < each:
                    put([*pattern, (length, n)], 1, room - n * length)
                    n, repeats = 0, repeats - 1
                if repeats:
                    put(pattern, repeats, room)
                    break
            if not n:
                break
        each = limit // length
        if n // each:
            put([(length, each)], n // each, limit - each * length)
        if n % each:
            put([(length, n % each)], 1, limit - n % each * length)
        for room in [r for r in open_ if r == 0]:
            done += open_.pop(room)
    return done + [b for bins in open_.values() for b in bins]


def plan(histogram: dict[int, int], limit: int, per_length: int = 12) -> tuple[np.ndarray, int]:
    """(runs, sequences): rows (length, first rank, copies a sequence, first sequence, offset), ordered by length and rank; a run ends where the next begins."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    places, copies = patterns(lengths, counts, limit, per_length)
    repeats, left = rounded(least_squares(places, copies, counts), places, copies, counts)
    chosen = [([(int(lengths[p]), int(c)) for p, c in zip(places[j], copies[j]) if p >= 0], int(repeats[j])) for j in np.flatnonzero(repeats).tolist()]
    some = np.flatnonzero(left)
    chosen += best_fit(lengths[some].tolist(), left[some].tolist(), limit)
    rank, sequences, runs = dict.fromkeys(lengths.tolist(), 0), 0, []
    for pattern, times in chosen:
        offset = 0
        for length, each in pattern:
            runs.append((length, rank[length], each, sequences, offset))
            rank[length] += each * times
            offset += each * length
        sequences += times
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


# -- the placing, on all pieces -------------------------------------------------------------------------


def pack(pieces: DataFrame, limit: int = 2048, per_length: int = 12) -> DataFrame:
    """``pieces`` (``length`` from 1 to ``limit``, any other columns) with ``sequence_id`` and ``offset``: gapless from 0 in each sequence."""
    columns = pieces.columns
    held = stored(pieces.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counted = stored(held.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most ``limit`` rows
    if any(not 0 < n <= limit for n in histogram):
        raise ValueError(f"pieces must have 1 to {limit} tokens")
    runs = pieces.sparkSession.sparkContext.broadcast(plan(histogram, limit, per_length)[0])
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counted.select(F.col("length").alias("__length"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__at")) - 1
    ranked = held.withColumn("__rank", rank).join(begins, (F.col("length") == F.col("__length")) & (F.col("__part") == F.col("__p")))
    ranked = ranked.select(*columns, (F.col("__rank") + F.col("__before")).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        key = (table[:, 0] << 48) + table[:, 1]
        of = columns.index("length")
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (of, len(columns)))
            row = table[np.searchsorted(key, (length.astype(np.int64) << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], names=[*columns, "sequence_id", "offset"])

    out = ranked.select(*columns, "__rank")
    schema = out.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")
    return out.mapInArrow(run, schema)
