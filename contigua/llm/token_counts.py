"""Token counts by byte-pair merging with a heap over a linked list of symbols.

A word's symbols are a doubly linked list; every adjacent pair that has a merge rank is in a heap
keyed by (rank, position). The lowest is popped, checked for staleness, merged in place, and the pairs
on either side of the new symbol are pushed. Each merge removes one symbol, so

    tokens = initial symbols - merges

and no identifier is ever looked up. Text never crosses white space in this family of tokenizers, so
the count of a white-space-delimited chunk is a function of the chunk alone; each Python worker keeps
a bounded table of chunks that it has merged before (longer ones, such as a text without white space, are not kept).

Defined results: a null or empty text has 0 bytes and 0 tokens; white space alone has 0 tokens; repeated
rows give repeated results; columns other than the two named are ignored; an empty table gives an empty
result with the same schema. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Chunks that a worker remembers, beyond which the table is emptied, and their most characters. Only speed depends on it.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

#: What became a letter or a number after Unicode 16.0, the version by which these tokenizers tell words; newer
#: classes of ``regex`` are taken back to it.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a
11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""

#: Lower cases that Unicode 16.0 added.
LATE_LOWER = {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0x1C89: 0x1C8A} | {0x10D50 + i: 0x10D70 + i for i in range(22)}
_LATE = regex.compile("[" + "".join(map(chr, LATE_LOWER)) + "]")

_COUNTERS: dict[str, "MergeCounter"] = {}


def byte_symbols() -> list[str]:
    """A printable character for every byte: itself where it is visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def folded(text: str) -> str:
    """As the tokenizers of this family normalise: composed, letters in lower case one by one."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased alone, so never a final sigma
        if _LATE.search(text):
            text = text.translate(LATE_LOWER)
    return text.lower()


class _Chunks(dict):
    """Chunk -> tokens; a missing one is computed, and the table is emptied when full."""

    def __init__(self, counter: "MergeCounter"):
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        n = self.counter.chunk_tokens(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class MergeCounter:
    """Counts tokens for a word-end byte-pair vocabulary given as the JSON of its published file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.known = model["vocab"].keys()
        self.word_end = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        split = next(p for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        pattern = split["pattern"]["Regex"]
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
        self.words = regex.compile(pattern, regex.V1)
        special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_hint = special
        self.chunks = _Chunks(self)

    def merged_length(self, symbols: list[str]) -> int:
        """Symbols left when no adjacent pair has a rank any more."""
        rank = self.rank
        left = len(symbols)
        if left < 2:
            return left
        after = list(range(1, left + 1))
        before = list(range(-1, left - 1))
        end = left
        heap = [(r, i) for i in range(left - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            a = symbols[i]
            j = after[i]
            if a is None or j >= end or rank.get((a, symbols[j])) != r:
                continue
            symbols[i] = a + symbols[j]
            symbols[j] = None
            left -= 1
            j = after[i] = after[j]
            if j < end:
                before[j] = i
                if (r := rank.get((symbols[i], symbols[j]))) is not None:
                    heapq.heappush(heap, (r, i))
            j = before[i]
            if j >= 0 and (r := rank.get((symbols[j], symbols[i]))) is not None:
                heapq.heappush(heap, (r, j))
        return left

    def word_tokens(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.word_end
        return self.merged_length([s for s in symbols if s in self.known])

    def chunk_tokens(self, chunk: str) -> int:
        return sum(map(self.word_tokens, self.words.findall(chunk)))

    def _plain(self, text: str) -> int:
        text = folded(text)
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to str.split, not to the pattern
            return self.chunk_tokens(text)
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(s in text for s in self.special_hint):
            return self._plain(text)
        total, at = 0, 0
        for hit in self.special.finditer(text):
            total += self._plain(text[at : hit.start()]) + 1
            at = hit.end()
        return total + self._plain(text[at:])


def counter_for(spec: str) -> MergeCounter:
    """One counter per worker process and vocabulary; its tables outlive a task."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = MergeCounter(spec)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of the tokenizer's JSON file on the driver. It is sent to the executors
    once; its size is that of the file (1.7 MB for the 49k vocabulary), whatever the input's.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(spec.value)
        for batch in batches:
            texts = batch.column(1)
            tokens, sizes = [], []
            for t in texts:
                t = t.as_py()
                tokens.append(counter.count(t))
                sizes.append(0 if t is None else len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
