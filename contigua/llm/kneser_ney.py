"""Quality classifier: interpolated modified Kneser-Ney n-grams of words, trained on trusted text.

The units are white-space-separated words, as they are spelt; words fall in 2**CLASS_BITS classes by hash, so the vocabulary
is open, every script has words, and a trigram is one integer. A text is framed by class 0. One model a language. What the
model gathers (n-grams, their contexts) covers all trusted rows and grows with them. ``order`` is 2 or 3; what is said of
trigrams below holds of bigrams too, which are kept as trigrams whose first word is class 0. Trigrams double what is shuffled.

Training: tasks count the trigrams of blocks of trusted texts; Spark deals the counts by shard, and each shard is merged in a
stream. A shard is all trigrams of some middle words: a trigram, its bigram and both contexts have the middle word in common,
so every count of orders 3 and 2 is local. The rest is small: counts of counts per language for the discounts, and
per word the number of words before it (order 1).

Scoring by sharded count joins: blocks of texts become per-shard lists (trigram, document, count), compressed; a shard's
model and its lists meet in one sorted partition, model first, and stream through; each list gives a vector of
log-likelihoods of its block's documents, and the vectors of a block are summed. No task ever holds the whole model, and
neither side is broadcast.

Bounds and skew: the number of shards follows the trusted words, so a shard has about ``shard_words`` of them; lists are dealt to so many
copies of a shard's model that a copy meets about ``list_words`` words. A middle word of more than that is a hot one: its trigrams are
dealt by their last word over shards of its own, each with the contexts of the word (at most 2**CLASS_BITS of them, merged
over these shards). A pair of middle and last word that is hot has a shard of its own with as many copies as it needs. Hot words and
pairs are found in a sample of the rows: it decides where things are, never what is counted.

Decision: one trusted row in five is held out of training; their log-perplexity sets an upper fence per language and
band of lengths (short texts scatter more), from quantiles over all of them. Texts above are rejected.

Defined results: a null text is an empty one (only its end is scored); a null language is a language of its own, apart from
the empty one, and returned as null; a language without trusted text has no model: null perplexity, kept; labels that
are null don't make a row trusted; rows are told apart by id (null or not), language and text, and equal rows are one,
in training and in results; an empty table gives an empty result; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from contigua.llm.common import give_back, once, row_key, shuffle_width, sized, stored

CLASS_BITS = 21
CLASSES = 1 << CLASS_BITS
#: Words of the texts that are turned into lists at once; at most 65,535 of them may differ, and be of so many texts.
BLOCK_WORDS = 1 << 18
#: Bytes of a text that are split into words at once.
STRETCH = 4 << 20
#: Pieces of a language's table of words.
PARTS = 8
#: One row in so many, by hash, is looked at for hot words.
SAMPLE = 16
#: Below it a context could leave nothing for unseen words, and a text have probability 0.
LEAST_DISCOUNT = 0.1
#: One trusted row in so many, by hash of its id, is kept out of training and sets the thresholds.
HELD_OUT = 5
#: Lengths (in words) at which a new band of thresholds begins.
BANDS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: So many rows of the average are added to a band or a language when its spread is taken.
PRIOR = 10
MASK = np.uint64(CLASSES - 1)
B1, B2 = np.uint64(CLASS_BITS), np.uint64(2 * CLASS_BITS)


# -- words and blocks -------------------------------------------------------------------------------


def classes(words: list[bytes]) -> np.ndarray:
    """1 to 2**CLASS_BITS - 1."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) % (CLASSES - 1) for w in words), np.int64, len(words)).astype(np.uint64) + np.uint64(1)


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The classes of a text with two framing zeros before it and one behind, in stretches that share two classes."""
    at, tail = 0, np.zeros(2, np.uint64)
    while True:
        end = at + STRETCH
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        own = np.concatenate([tail, classes(text[at:end].split())])
        if end >= len(text):
            yield np.append(own, np.uint64(0))
            return
        yield own
        at, tail = end, own[-2:]


class Block:
    """Texts of one language: their keys and, per trigram, the number of its text and its three classes."""

    def __init__(self, lang: str, keys: list, runs: list[np.ndarray]):
        self.lang, self.keys = lang, keys
        self.doc = np.repeat(np.arange(len(runs), dtype=np.uint64), [len(r) - 2 for r in runs])
        self.w1, self.w2, self.w3 = (np.concatenate([r[i : len(r) - 2 + i] for r in runs]) for i in range(3))


def blocks(batches: Iterator[pa.RecordBatch], order: int = 3) -> Iterator[Block]:
    """Of the columns (lang, text, keys ...); for ``order`` 2 without first words."""
    for block in _blocks(batches):
        if order == 2:
            block.w1 = np.zeros_like(block.w1)
        yield block


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: dict[str, tuple[list, list, int]] = {}
    total = 0
    for batch in batches:
        for lang, text, *keys in zip(*batch.columns):
            lang = lang.as_py()
            for part in pieces(text.as_py()):
                for at in range(0, len(part) - 2, BLOCK_WORDS):
                    run = part[at : at + BLOCK_WORDS + 2]
                    own, runs, size = held.pop(lang, ([], [], 0))
                    own.append(tuple(k.as_py() for k in keys))
                    runs.append(run)
                    size, total = size + len(run), total + len(run)
                    held[lang] = (own, runs, size)
                    if size >= BLOCK_WORDS or len(own) == 65_535:
                        total -= held.pop(lang)[2]
                        yield Block(lang, own, runs)
                    if total >= 4 * BLOCK_WORDS:  # many languages
                        for some, (own, runs, _) in held.items():
                            yield Block(some, own, runs)
                        held, total = {}, 0
    for lang, (own, runs, _) in held.items():
        yield Block(lang, own, runs)


def lists(block: Block, plan: "Plan", copy: int) -> Iterator[tuple[int, int, bytes]]:
    """(shard, copy, list) of a block. A list holds the classes that it uses, its trigrams in order, texts and counts, in planes
    of bytes, so that what compresses does.

    Trigrams are (middle, last, first) numbers of the block's own classes; where these are more than 65,535, halves.
    """
    used = np.unique(np.concatenate([block.w1, block.w2, block.w3]))
    if len(used) > 65_535:
        mid = len(block.doc) // 2
        for part in (slice(0, mid), slice(mid, None)):
            half = Block.__new__(Block)
            half.lang, half.keys = block.lang, block.keys
            half.doc, half.w1, half.w2, half.w3 = block.doc[part], block.w1[part], block.w2[part], block.w3[part]
            yield from lists(half, plan, copy)
        return
    shard_of = plan.shards(block.lang, used)
    order = np.argsort(shard_of, kind="stable")
    used, shard_of = used[order], shard_of[order]  # middle words in order of their shard
    number = np.zeros(CLASSES, np.uint64)
    number[used] = np.arange(len(used), dtype=np.uint64)
    v = np.uint64(len(used))
    code = (number[block.w2] * v + number[block.w3]) * v + number[block.w1]
    code, n = np.unique((code << np.uint64(16)) | block.doc, return_counts=True)
    doc, code = (code & np.uint64(65_535)).astype(np.uint16), code >> np.uint64(16)
    middle, last = code // (v * v), code // v % v
    shard, salt = plan.places(block.lang, shard_of[middle], used[middle], used[last], copy)
    place = shard * 65_536 + salt
    if (np.diff(place) < 0).any():  # hot words
        by = np.argsort(place, kind="stable")
        code, doc, n, place = code[by], doc[by], n[by], place[by]
    edges = np.flatnonzero(np.diff(place, prepend=-1)).tolist() + [len(place)]
    for a, e in zip(edges, edges[1:]):
        yield int(place[a] // 65_536), int(place[a] % 65_536), _packed(code[a:e], doc[a:e], n[a:e], used)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(raw: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel(), at + n * size


def _packed(code: np.ndarray, doc: np.ndarray, n: np.ndarray, used: np.ndarray) -> bytes:
    v = np.uint64(len(used))
    parts = (code // (v * v), code // v % v, code % v)
    seen = np.unique(np.concatenate(parts))
    number = np.zeros(len(used), np.uint64)
    number[seen] = np.arange(len(seen), dtype=np.uint64)
    u, last = np.uint64(len(seen)), np.uint64(len(seen) if used[parts[2]].any() else 1)  # without first words only pairs are numbered
    code = (number[parts[0]] * u + number[parts[1]]) * last + (number[parts[2]] if last > 1 else np.uint64(0))
    step = np.diff(code, prepend=np.uint64(0))  # numbers keep their order, so steps are forward
    raw = len(seen).to_bytes(8, "little") + len(code).to_bytes(8, "little") + int(last).to_bytes(8, "little") + _planes(np.diff(used[seen].astype(np.int32), prepend=np.int32(0))) + _planes(step) + _planes(doc) + _planes(n.astype(np.uint32))
    return zstandard.ZstdCompressor(1).compress(raw)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(middle, last, first class, text, count) of a list."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    v, m, f = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8, 16))
    used, at = _unplaned(raw, 24, v, np.int32)
    step, at = _unplaned(raw, at, m, np.uint64)
    doc, at = _unplaned(raw, at, m, np.uint16)
    n, _ = _unplaned(raw, at, m, np.uint32)
    code, used, v, f = np.cumsum(step), np.cumsum(used).astype(np.uint64), np.uint64(v), np.uint64(f)
    return used[code // (v * f)], used[code // f % v], used[code % f] if f > 1 else np.zeros(m, np.uint64), doc, n


# -- where things are -------------------------------------------------------------------------------


def found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``known``, whether it is there)."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Plan:
    """Shards by language, hot words and hot pairs. Shards 0 .. n-1 are of ordinary middle words, then those of hot ones follow."""

    def __init__(self, sizes: dict[str, tuple[int, int]], hot_words: dict[tuple[str, int], int], hot_pairs: dict[tuple[str, int], int], shard_words: int, list_words: int):
        """``sizes``: all and trusted words by language; the others: words by (language, class), (language, pair)."""
        self.n, self.copies, self.hot, self.pairs = {}, {}, {}, {}
        for lang, (every, trusted) in sizes.items():
            self.n[lang] = n = max(1, ceil(trusted / shard_words))
            self.copies[lang] = min(65_535, max(1, ceil(every / n / list_words)))
        for (lang, word), m in sorted(hot_words.items()):
            first, parts = self.n[lang] + sum(p for _, p in self.hot.get(lang, {}).values()), max(1, ceil(m / list_words))
            self.hot.setdefault(lang, {})[word] = (first, parts)
        total = {lang: self.n[lang] + sum(p for _, p in self.hot.get(lang, {}).values()) for lang in self.n}
        for (lang, pair), m in sorted(hot_pairs.items()):
            if pair >> CLASS_BITS in self.hot.get(lang, {}):
                self.pairs.setdefault(lang, {})[pair] = (total[lang], min(65_535, max(1, ceil(m / list_words))))
                total[lang] += 1

    @staticmethod
    def _rows(table: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array(sorted(table), np.uint64), np.array([table[k] for k in sorted(table)], np.int64).reshape(-1, 2)

    def shards(self, lang: str, words: np.ndarray) -> np.ndarray:
        """Of middle words, hot ones in their first shard."""
        out = ((words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.n.get(lang, 1))).astype(np.int64)
        keys, rows = self._rows(self.hot.get(lang, {}))
        at, there = found(words, keys)
        out[there] = rows[at[there], 0]
        return out

    def places(self, lang: str, shard: np.ndarray, middle: np.ndarray, last: np.ndarray, copy: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, copy of it) of trigrams."""
        salt = np.full(len(shard), copy % self.copies.get(lang, 1), np.int64)
        if lang not in self.hot:
            return shard, salt
        keys, rows = self._rows(self.hot[lang])
        at, there = found(middle, keys)
        first, parts = rows[at[there]].T
        shard = shard.copy()
        shard[there] = first + ((last[there] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % parts.astype(np.uint64)).astype(np.int64)
        salt[there] = 0
        keys, rows = self._rows(self.pairs.get(lang, {}))
        at, there = found(middle << B1 | last, keys)
        shard[there], salt[there] = rows[at[there], 0], copy % rows[at[there], 1]
        return shard, salt

    def all_places(self) -> list[tuple[str, int, int]]:
        """(language, shard, copies) of all shards."""
        out = []
        for lang, n in self.n.items():
            out += [(lang, i, self.copies[lang]) for i in range(n)]
            out += [(lang, first + i, 1) for first, parts in self.hot.get(lang, {}).values() for i in range(parts)]
            out += [(lang, own, copies) for own, copies in self.pairs.get(lang, {}).values()]
        return out

    def hot_shards(self) -> list[tuple[str, int, int]]:
        """(language, middle word, shard) of the shards of hot words."""
        out = [(lang, word, first + i) for lang, own in self.hot.items() for word, (first, parts) in own.items() for i in range(parts)]
        return out + [(lang, pair >> CLASS_BITS, own) for lang, pairs in self.pairs.items() for pair, (own, _) in pairs.items()]


def planned(rows: DataFrame, trusted: DataFrame, shard_words: int, list_words: int) -> Plan:
    """Sizes come from the bytes of all texts; what is hot from one row in SAMPLE. A row a language, and of hot words at most all words
    over ``list_words``, reach the driver."""
    bytes_of = lambda df: {r.lang: r.n for r in df.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    every, known = bytes_of(rows), bytes_of(trusted)
    sizes = {lang: (n // 6 + 1, known[lang] // 6 + 1) for lang, n in every.items() if lang in known}
    if max((n for n, _ in sizes.values()), default=0) <= list_words:
        return Plan(sizes, {}, {}, shard_words, list_words)
    least = max(1, list_words // SAMPLE)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            word, n = np.unique(b.w2, return_counts=True)
            pair, m = np.unique(b.w2 << B1 | b.w3, return_counts=True)
            often = m >= 8  # what is hot overall is so in some block
            keys = np.concatenate([word, pair[often]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b.lang] * len(keys)), pa.array(np.arange(len(keys)) >= len(word)), pa.array(keys), pa.array(np.concatenate([n, m[often]]).astype(np.int64))], names=["lang", "pair", "key", "n"])

    seen = rows.filter(F.pmod("k1", F.lit(SAMPLE)) == 0).select("lang", "text").mapInArrow(look, "lang string, pair boolean, key long, n long")
    hot = seen.groupBy("lang", "pair", "key").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    words = {(r.lang, r.key): r.n * SAMPLE for r in hot if not r.pair and r.lang in sizes}
    pairs = {(r.lang, r.key): r.n * SAMPLE for r in hot if r.pair and r.lang in sizes}
    return Plan(sizes, words, pairs, shard_words, list_words)


# -- counts and the model ---------------------------------------------------------------------------


def prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc, lang, text, k1, k2), one of equal rows; a language is given a sign before it, so that none is the empty string."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc, lang = F.col(id_col).cast("long"), F.col(lang_col).cast("string")
    rows = docs.select(doc.alias("doc"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("lang"), text.cast("binary").alias("text"), *row_key(doc, lang, text))
    return once(rows, "k1", "k2")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def count_shards(trusted: DataFrame, plan: Plan, order: int) -> DataFrame:
    """(lang, shard, grams, counts): trigrams as (middle, last, first) in order and how often trusted texts have them."""
    sent = trusted.sparkSession.sparkContext.broadcast(plan)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, order):
            b.doc = b.doc * np.uint64(0)  # whose they are does not matter
            out = [(b.lang, shard, piece) for shard, _, piece in lists(b, sent.value, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "shard", "piece"])
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def row() -> pa.RecordBatch:
            grams, n = merged()
            z = zstandard.ZstdCompressor(1)
            packed = z.compress(_planes(np.diff(grams, prepend=np.uint64(0)))), z.compress(_planes(n))
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int32()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], names=["lang", "shard", "grams", "counts"])

        for batch in batches:
            for lang, shard, piece in zip(*batch.columns):
                key = (lang.as_py(), shard.as_py())
                if held is not None and key != held:
                    yield row()
                    parts = []
                held = key
                middle, last, first, _, n = unpacked(piece.as_py())
                grams = middle << B2 | last << B1 | first
                parts.append((grams, n))
                if len(parts) == 16:
                    parts = [merged()]
        if held is not None:
            yield row()
        parts.clear()
        give_back()

    dealt = trusted.select("lang", "text").mapInArrow(count, "lang string, shard int, piece binary").repartition(shuffle_width(trusted.sparkSession), "lang", "shard").sortWithinPartitions("lang", "shard")
    return stored(dealt.mapInArrow(merge, "lang string, shard int, grams binary, counts binary"))


def _opened(grams: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    raw = z.decompress(grams)
    n = len(raw) // 8
    return np.cumsum(_unplaned(raw, 0, n, np.uint64)[0]), _unplaned(z.decompress(counts), 0, n, np.int64)[0]


def _figures(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per run of counts that begins at ``at``: their sum, and how many are 1, 2, and more."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(n, at), *(np.add.reduceat(x.astype(np.int32), at) for x in (n == 1, n == 2, n > 2))], 1).astype(np.int64)


def contexts_of(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (middle, first) in order, and per context: its total, and of how many trigrams once, twice, and oftener it is made."""
    key = grams >> B2 << B1 | grams & MASK
    order = np.argsort(key, kind="stable")
    key, n = key[order], counts[order]
    at = _runs(key)
    return key[at], _figures(n, at)


def middles_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams (middle, last), how many words come before each; middle words, and the same figures as of contexts over these numbers."""
    two = grams >> B1
    at = _runs(two)
    bigrams, n = two[at], np.diff(np.append(at, len(two)))
    word = bigrams >> B1
    first = _runs(word)
    return bigrams, n, word[first], _figures(n, first)


def small_tables(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n): per language, in PARTS pieces, the classes and the numbers of words before them, packed, at most 2**CLASS_BITS; (lang, d): the
    discounts d11 .. d33 of once, twice, oftener for orders 1 to 3."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, grams, counts in zip(*batch.columns):
                grams, counts = _opened(grams.as_py(), counts.as_py())
                bigrams, n, _, _ = middles_of(grams)
                word, before = np.unique(bigrams & MASK, return_counts=True)
                of = lambda x: [int((x == i).sum()) for i in (1, 2, 3, 4)]
                keys = word.astype(np.int64).tolist() + [-31, -32, -33, -34, -21, -22, -23, -24]
                m = before.tolist() + of(counts) + of(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(keys)), pa.array(keys, pa.int64()), pa.array(m, pa.int64())], names=["lang", "key", "n"])

    sums = stored(shards.select("lang", "grams", "counts").mapInArrow(look, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    words = sums.filter("key >= 0")
    of_words = words.filter("n < 5").groupBy("lang", (-F.col("n") - 10).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    n = {(k, i): F.coalesce(F.max(F.when(F.col("key") == -10 * k - i, F.col("n"))), F.lit(0)).cast("double") for k in (1, 2, 3) for i in (1, 2, 3, 4)}
    fixed = (0.5, 1.0, 1.5)  # where a count of counts is zero

    def discount(k: int, i: int) -> Column:
        own = F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), i - (i + 1) * n[k, 1] / (n[k, 1] + 2 * n[k, 2]) * n[k, i + 1] / n[k, i]))
        return F.when((n[k, i] > 0) & (n[k, 1] > 0), own).otherwise(fixed[i - 1]).cast("double")

    discounts = sums.filter("key < 0").unionByName(of_words).groupBy("lang").agg(F.array(*(discount(k, i) for k in (1, 2, 3) for i in (1, 2, 3))).alias("d"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            key, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in batch.column(0).unique().to_pylist():
                of_lang = pc.equal(batch.column(0), lang).to_numpy(zero_copy_only=False)
                for part in np.unique(key[of_lang] % PARTS).tolist():
                    own = of_lang & (key % PARTS == part)
                    held.setdefault((lang, part), []).append((key[own], n[own]))
        z = zstandard.ZstdCompressor(3)
        for (lang, _), parts in held.items():
            key, n = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(key)
            raw = _planes(np.diff(key[order], prepend=0)), _planes(n[order])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([z.compress(raw[0])], pa.binary()), pa.array([z.compress(raw[1])], pa.binary())], names=["lang", "words", "n"])

    packed = words.repartition(shuffle_width(shards.sparkSession), "lang", F.pmod("key", F.lit(PARTS))).mapInArrow(pack, "lang string, words binary, n binary")
    return stored(packed), stored(discounts)


def hot_contexts(shards: DataFrame, plan: Plan) -> DataFrame:
    """(lang, shard, contexts): for the shards of hot words the merged contexts of their middle word, and that word's own figures."""
    spark = shards.sparkSession
    places = spark.createDataFrame(plan.hot_shards(), "lang string, word long, shard int")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, grams, counts in zip(*batch.columns):
                grams, counts = _opened(grams.as_py(), counts.as_py())
                key, figures = contexts_of(grams, counts)
                _, _, word, own = middles_of(grams)
                keys = np.concatenate([key >> B1, word]).astype(np.int64)
                firsts = np.concatenate([(key & MASK).astype(np.int64), np.full(len(word), -1)])
                every = np.concatenate([figures, own])
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(keys)), pa.array(keys), pa.array(firsts), *(pa.array(c) for c in every.T.copy())], names=["lang", "word", "first", "n", "n1", "n2", "n3"])

    own = shards.join(F.broadcast(places.select("lang", "shard")), ["lang", "shard"], "left_semi").select("lang", "grams", "counts")
    sums = own.mapInArrow(look, "lang string, word long, first long, n long, n1 long, n2 long, n3 long").groupBy("lang", "word", "first").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def row() -> pa.RecordBatch:
            raw = np.concatenate(parts)
            packed = zstandard.ZstdCompressor(1).compress(_planes(np.ascontiguousarray(raw).ravel()))
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([packed], pa.binary())], names=["lang", "word", "contexts"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            figures = np.stack([c.to_numpy() for c in batch.columns[2:]], 1)
            edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, e in zip(edges, edges[1:]):
                if a < e:
                    if held is not None and keys[a] != held:
                        yield row()
                        parts = []
                    held = keys[a]
                    parts.append(figures[a:e])
        if held is not None:
            yield row()

    packed = sums.repartition(shuffle_width(spark), "lang", "word").sortWithinPartitions("lang", "word", "first").mapInArrow(pack, "lang string, word long, contexts binary")
    return packed.join(F.broadcast(places), ["lang", "word"]).select("lang", "shard", "word", "contexts")


class Model:
    """A shard's tables."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, words: np.ndarray, before: np.ndarray, d: list[float], order: int):
        self.order = order
        self.d = np.concatenate([[[0.0]] * 3, np.array(d).reshape(3, 3)], 1)  # by order and by count up to 3
        self.grams, self.counts = grams, counts
        self.contexts, self.context_figures = contexts_of(grams, counts)
        self.bigrams, self.bigram_counts, self.middles, self.middle_figures = middles_of(grams)
        self.words, self.before = words, before
        self.total = max(1, int(before.sum()))
        self.left = float(self.d[0][np.minimum(before, 3)].sum()) / self.total / CLASSES

    def use_contexts(self, word: int, first: np.ndarray, figures: np.ndarray) -> None:
        """Of a hot middle word: the contexts over all its shards."""
        own = self.contexts >> B1 == np.uint64(word)
        keys = np.concatenate([self.contexts[~own], np.uint64(word) << B1 | first[first >= 0].astype(np.uint64)])
        every = np.concatenate([self.context_figures[~own], figures[first >= 0]])
        order = np.argsort(keys)
        self.contexts, self.context_figures = keys[order], every[order]
        rest = self.middles != np.uint64(word)
        keys = np.append(self.middles[rest], np.uint64(word))
        every = np.concatenate([self.middle_figures[rest], figures[first < 0]])
        order = np.argsort(keys)
        self.middles, self.middle_figures = keys[order], every[order]

    def _counted(self, keys: np.ndarray, known: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """Counts less their discount."""
        at, there = found(keys, known)
        n = np.where(there, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)
        return n - self.d[k - 1][np.minimum(n, 3)]

    def _interpolated(self, seen: np.ndarray, keys: np.ndarray, known: np.ndarray, figures: np.ndarray, k: int, below: np.ndarray) -> np.ndarray:
        at, there = found(keys, known)
        if not len(known):
            return below
        n, n1, n2, n3 = figures[at].T.astype(float)
        mass = n1 * self.d[k - 1][1] + n2 * self.d[k - 1][2] + n3 * self.d[k - 1][3]
        return np.where(there, (seen + mass * below) / n, below)

    def log_probability(self, middle: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self._counted(last, self.words, self.before, 1) / self.total + self.left
        if self.order == 3:
            p = self._interpolated(self._counted(middle << B1 | last, self.bigrams, self.bigram_counts, 2), middle, self.middles, self.middle_figures, 2, p)
        return np.log(self._interpolated(self._counted(middle << B2 | last << B1 | first, self.grams, self.counts, 3), middle << B1 | first, self.contexts, self.context_figures, 3, p))


# -- scores -----------------------------------------------------------------------------------------


def perplexities(rows: DataFrame, trusted: DataFrame, order: int = 2, shard_words: int = 2 << 20, list_words: int = 8 << 20) -> DataFrame:
    """(k1, k2, n_words, perplexity) of the ``prepared`` rows whose language has a model; ``trusted`` are those it learns from.

    ``n_words`` counts the end of the text as one.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = rows.sparkSession
    plan = planned(rows, trusted, shard_words, list_words)
    sent = spark.sparkContext.broadcast(plan)
    shards = count_shards(trusted, plan, order)
    words, discounts = small_tables(shards)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "shard", "copy", "kind", "block", "a", "b", "word"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        task = TaskContext.get().partitionId().to_bytes(8, "little")
        for number, b in enumerate(blocks(batches, order)):
            if b.lang not in sent.value.n:
                continue
            keys = np.array(b.keys, np.int64)
            block = xxhash.xxh64_intdigest(keys.tobytes() + task + number.to_bytes(8, "little")) >> 1
            out = [(b.lang, shard, copy, 3, block, piece, None, None) for shard, copy, piece in lists(b, sent.value, block)]
            length = np.bincount(b.doc.astype(np.int64), minlength=len(keys)).astype(np.int64)
            out.append((b.lang, -1, block % 65_521, 3, block, keys.tobytes(), length.tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        give_back()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, d = None, [], zstandard.ZstdDecompressor()
        out: list[tuple] = []

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "keys", "length", "share"])

        for batch in batches:
            for shard, kind, block, a, b, word, discounts in zip(*(batch.column(i) for i in (1, 3, 4, 5, 6, 7, 8))):
                kind = kind.as_py()
                if kind == 0:
                    raw = d.decompress(a.as_py())
                    m = len(raw) // 8
                    words.append((np.cumsum(_unplaned(raw, 0, m, np.int64)[0]).astype(np.uint64), _unplaned(d.decompress(b.as_py()), 0, m, np.int64)[0]))
                elif kind == 1:
                    known, before = (np.concatenate(x) for x in zip(*words))
                    by = np.argsort(known)
                    model, words = Model(*_opened(a.as_py(), b.as_py()), known[by], before[by], discounts.as_py(), order), []
                elif kind == 2:
                    raw = d.decompress(a.as_py())
                    figures = _unplaned(raw, 0, len(raw) // 8, np.int64)[0].reshape(-1, 5)
                    model.use_contexts(word.as_py(), figures[:, 0], figures[:, 1:])
                elif shard.as_py() < 0:
                    out.append((block.as_py(), a.as_py(), b.as_py(), None))
                else:
                    middle, last, first, doc, n = unpacked(a.as_py())
                    new = _runs(middle << B2 | last << B1 | first)
                    logs = np.repeat(model.log_probability(middle[new], last[new], first[new]), np.diff(np.append(new, len(doc))))
                    used, at = np.unique(doc, return_inverse=True)
                    share = np.bincount(at, logs * n).astype(np.float32)
                    out.append((block.as_py(), used.tobytes(), None, share.tobytes()))
                if len(out) == 256:
                    yield rows_of(out)
                    out = []
        yield rows_of(out)
        out.clear()
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, length, total = None, b"", b"", np.zeros(0)

        def scored() -> pa.RecordBatch:
            own, n = np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(length, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(total[: len(n)]), pa.array(n)], names=["k1", "k2", "log_p", "n_words"])

        for batch in batches:
            for block, own, n, share in zip(*batch.columns):
                if block.as_py() != held:
                    if held is not None:
                        yield scored()
                    held, keys, length, total = block.as_py(), b"", b"", np.zeros(65_536)
                if share.as_py() is None:
                    keys, length = own.as_py(), n.as_py()
                else:
                    total[np.frombuffer(own.as_py(), np.uint16)] += np.frombuffer(share.as_py(), np.float32)
        if held is not None:
            yield scored()
        give_back()

    schema = "lang string, shard int, copy int, kind int, block long, a binary, b binary, word long"
    posted = rows.select("lang", "text", "k1", "k2").mapInArrow(post, schema).withColumn("discounts", F.lit(None).cast("array<double>"))
    places = spark.createDataFrame(plan.all_places(), "lang string, shard int, copies int").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    none = F.lit(bytearray(zstandard.ZstdCompressor(1).compress(b"")))

    def sent_to(table: DataFrame, kind: int, a: Column, b: Column, word: Column, d: Column) -> DataFrame:
        return table.select("lang", "shard", "copy", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("block"), a.alias("a"), b.alias("b"), word.alias("word"), d.alias("discounts"))

    no_word, no_d, no_bytes = F.lit(None).cast("long"), F.lit(None).cast("array<double>"), F.lit(None).cast("binary")
    streams = posted.unionByName(sent_to(places.join(words, "lang"), 0, F.col("words"), F.col("n"), no_word, no_d))
    streams = streams.unionByName(sent_to(places.join(shards, ["lang", "shard"], "left").join(discounts, "lang"), 1, F.coalesce("grams", none), F.coalesce("counts", none), no_word, F.col("d")))
    if plan.hot:
        own = hot_contexts(shards, plan).join(places.select("lang", "shard", "copy"), ["lang", "shard"])
        streams = streams.unionByName(sent_to(own, 2, F.col("contexts"), no_bytes, F.col("word"), no_d))
    width = shuffle_width(spark)
    met = streams.repartition(width, "lang", "shard", "copy").sortWithinPartitions("lang", "shard", "copy", "kind").mapInArrow(solve, "block long, keys binary, length binary, share binary")
    summed = met.repartition(width, "block").sortWithinPartitions("block").mapInArrow(add, "k1 long, k2 long, log_p double, n_words long")
    scored = summed.groupBy("k1", "k2").agg(F.sum("log_p").alias("log_p"), F.sum("n_words").alias("n_words"))
    return scored.select("k1", "k2", "n_words", F.exp(-F.col("log_p") / F.col("n_words")).alias("perplexity"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(id_col)


def weighted_quantile(x: np.ndarray, n: np.ndarray, q: float) -> float:
    """The least of the sorted values at which their counts reach the share ``q``."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    return float(x[order][np.searchsorted(upto, q * upto[-1] - 1e-9)])


def fences(held: DataFrame, quantile: float, reach: float) -> DataFrame:
    """(lang, band, most) from the held-out rows (lang, band, l: log-perplexity), by one rule at every size.

    The middle of a language and band is a median of the language plus an offset of the band over all languages. Residuals
    are divided by their median size in the band, then in the language, each shrunk towards that of all rows by
    PRIOR rows, so that a band or language of one row, or a band of none, has a width too. ``quantile`` of
    what results comes from all held-out rows. A text is kept up to ``reach`` times as far from the middle.

    All rows are counted, by hundredths: a row a language, band and hundredth reaches the driver, some hundreds a language.
    """
    spark = held.sparkSession
    out = "lang string, band int, most double"
    rows = held.groupBy("lang", "band", F.round(F.col("l") * 100).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if not len(rows):
        return spark.createDataFrame([], out)
    langs, lang = np.unique(rows["lang"].to_numpy(str), return_inverse=True)
    band, x, n = rows["band"].to_numpy(), rows["x"].to_numpy() / 100, rows["n"].to_numpy()
    bands = range(len(BANDS) + 1)

    def medians(values: np.ndarray, by: np.ndarray, groups: range, prior: float | None = None) -> np.ndarray:
        """Of each group; with ``prior``, shrunk towards it."""
        got = []
        for g in groups:
            own = by == g
            m, size = (weighted_quantile(values[own], n[own], 0.5), int(n[own].sum())) if own.any() else (prior or 0.0, 0)
            got.append(m if prior is None else (m * size + prior * PRIOR) / (size + PRIOR))
        return np.array(got)

    each = range(len(langs))
    offset = medians(x - medians(x, lang, each)[lang], band, bands, 0.0)
    middle = medians(x - offset[band], lang, each)
    rest = x - offset[band] - middle[lang]
    unit = max(weighted_quantile(np.abs(rest), n, 0.5), 0.01)
    by_band = np.maximum(medians(np.abs(rest) / unit, band, bands, 1.0), 1e-6)
    by_lang = np.maximum(medians(np.abs(rest) / unit / by_band[band], lang, each, 1.0), 1e-6)
    tail = max(0.0, weighted_quantile(rest / unit / by_band[band] / by_lang[lang], n, quantile))
    most = [(str(langs[i]), j, float(np.exp(offset[j] + middle[i] + tail * by_band[j] * by_lang[i] * unit * reach))) for i in each for j in bands]
    return spark.createDataFrame(most, out)


def classified(rows: DataFrame, trusted: DataFrame, quantile: float, reach: float, id_col: str, **sizes: int) -> DataFrame:
    """(k1, k2, doc, lang, n_words, perplexity, most, keep) of ``prepared`` rows."""
    ids = stored(trusted.select(F.col(id_col).cast("long").alias("doc")).filter("doc IS NOT NULL").distinct().withColumn("held_out", F.pmod(F.xxhash64("doc"), F.lit(HELD_OUT)) == 0))
    learnt = sized(ids.filter(~F.col("held_out")).select("doc"), 8)
    scored = perplexities(rows, rows.join(learnt, "doc", "left_semi"), **sizes)
    band = reduce(lambda a, b: a + b, [(F.col("n_words") >= n).cast("int") for n in BANDS])
    named = rows.select("k1", "k2", "doc", "lang").join(scored, ["k1", "k2"], "left").withColumn("band", F.coalesce(band, F.lit(0)))
    named = stored(named.join(sized(ids), "doc", "left"))
    held = named.filter(F.col("held_out") & F.col("perplexity").isNotNull()).select("lang", "band", F.log("perplexity").alias("l"))
    bounds = fences(held, quantile, reach)
    keep = F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(True))
    lang = F.when(F.col("lang") != "", F.expr("substring(lang, 2)"))
    return named.join(F.broadcast(bounds), ["lang", "band"], "left").select("k1", "k2", "doc", lang.alias("lang"), "n_words", "perplexity", "most", keep.alias("keep"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, reach: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """Per distinct row (id, language, text): ``doc``, ``lang``, ``n_words``, ``perplexity``, ``most``, ``keep``.

    A text is kept where its perplexity does not pass the fence of its language and band of lengths.
    """
    return classified(prepared(docs, id_col, text_col, lang_col), trusted, quantile, reach, id_col, **sizes).drop("k1", "k2")


def keep_good(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, reach: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns, repeated ones as often as they are there."""
    found = classified(prepared(docs, id_col, text_col, lang_col), trusted, quantile, reach, id_col, **sizes)
    bad = sized(stored(found.filter(~F.col("keep")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))))
    k1, k2 = row_key(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.select("*", k1.alias("__own1"), k2.alias("__own2"))
    return own.join(bad, (F.col("__own1") == F.col("__k1")) & (F.col("__own2") == F.col("__k2")), "left_anti").select(*docs.columns)
