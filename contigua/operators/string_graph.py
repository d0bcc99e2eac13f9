"""Sequences with alternatives at some places, seen through a window.

A place is a base of the sequence, or, where there is a choice, one text of several: another base, none, or more than one.
Only what fits the window is kept on the way: walks with the same text at the same place are one, with the least of their
choices, so the work follows the distinct windows and not the product of the alternatives. The places of many sequences,
laid end to end, are swept together as arrays, from choice to choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

_SCHEMA = "header string, pos long, inset long, kmer string, choices string"
PIECE, BLOCK, CELLS = 1 << 18, 1 << 14, 1 << 22  # characters laid end to end; places swept together; bases of the windows held at once


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and the number of the repeat."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class _Laid:
    """Sequences end to end, and behind them, in one pool, the texts of the choices. ``packed``: for each place of the pool the ``per`` letters
    from there, as numbers from 1 of some ``bits``; ``stops``: each sequence's
    end; ``sites``: the places with choices; options ``first[i]`` to ``first[i + 1]`` are those of site i: a choice and a stretch of the pool."""

    letters: np.ndarray
    packed: np.ndarray
    bits: int
    per: int
    stops: np.ndarray
    sites: np.ndarray
    first: np.ndarray
    choice: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    names: list[str]


def _lay(texts: list[str], row: np.ndarray, pos: np.ndarray, choices: pa.Array, alternatives: pa.Array, k: int) -> _Laid:
    """``row``, ``pos``: the sequence and the place of each alternative; ``k``: the letters of a window."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths)
    inside = (pos >= 0) & (pos < lengths[row])
    chosen, given = choices.filter(pa.array(inside)).dictionary_encode(), alternatives.filter(pa.array(inside)).dictionary_encode()
    names = sorted({"0", *chosen.dictionary.to_pylist()})
    rank = {name: i for i, name in enumerate(names)}
    distinct = given.dictionary.to_pylist()
    letters, pool = np.unique(np.frombuffer("".join([*texts, *distinct]).encode("utf-32-le"), "<u4"), return_inverse=True)
    bits = len(letters).bit_length()
    per = min(k, 63 // bits) if bits else k
    at = ((stops - lengths)[row] + pos)[inside]
    sites = np.unique(at)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    number = np.concatenate([np.full(len(sites), -1), given.indices.to_numpy(zero_copy_only=False).astype(np.int64)])  # -1: the sequence's own base
    place = np.concatenate([sites, at])
    choice = np.concatenate([np.full(len(sites), rank["0"]), np.array([rank[c] for c in chosen.dictionary.to_pylist()], np.int64)[chosen.indices.to_numpy(zero_copy_only=False)]])
    begin = np.concatenate([sites, (stops[-1] + np.cumsum(size) - size)[number[len(sites) :]]])
    length = np.concatenate([np.ones(len(sites), np.int64), size[number[len(sites) :]]])
    order = np.lexsort((number, choice, place))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(place[order]) != 0) | (np.diff(choice[order]) != 0) | (np.diff(number[order]) != 0)
    order = order[new]  # each once, however often it is given
    first = np.append(np.searchsorted(place[order], sites), len(order))
    return _Laid(letters, _packed(pool + 1, bits, per), bits, per, stops, sites, first, choice[order], begin[order], length[order], names)


def _packed(pool: np.ndarray, bits: int, per: int) -> np.ndarray:
    """At each place of the pool the ``per`` letters from there as one number, the first highest; 0 behind the end."""
    padded = np.concatenate([pool, np.zeros(per, np.int64)])
    packed = np.zeros(len(pool) + 1, np.int64)
    for c in range(per):
        packed <<= bits
        packed |= padded[c : c + len(packed)]
    return packed


def _write(text: list[np.ndarray], length: np.ndarray, packed: np.ndarray, bits: int, per: int, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Puts stretches of the pool behind what ``text`` holds, a number for each ``per`` letters, and returns the new lengths."""
    end = length + count
    for w, word in enumerate(text):
        lo, hi = np.clip(length, w * per, (w + 1) * per), np.clip(end, w * per, (w + 1) * per)
        source = np.minimum(begin + (lo - length), len(packed) - 1)
        word |= (packed[source] >> bits * (per - (hi - lo))) << bits * ((w + 1) * per - hi)
    return end


def _lengths(text: list[np.ndarray], bits: int, per: int) -> np.ndarray:
    """How many letters texts hold."""
    return sum((((word >> bits * c) & ((1 << bits) - 1)) != 0).astype(np.int64) for word in text for c in range(per))


def _least(begin: np.ndarray, text: list[np.ndarray], code: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the rows with one begin and text that with the least code; ``width``: the bits of a text of one number."""
    tail = int(code.max(initial=0)).bit_length()
    if len(text) == 1 and int(begin.max(initial=0)).bit_length() + width + tail <= 63:  # all in one number
        key = (((begin << width) | text[0]) << tail) | code
        key.sort()
        key = key[np.append(True, np.diff(key >> tail) != 0)[: len(key)]]
        return key >> (width + tail), [(key >> tail) & ((1 << width) - 1)], key & ((1 << tail) - 1)
    order, new = np.lexsort((code, *reversed(text), begin)), np.zeros(len(begin), bool)
    new[:1] = True
    for word in (begin, *text):
        new[1:] |= np.diff(word[order]) != 0
    order = order[new]
    return begin[order], [word[order] for word in text], code[order]


def _named(names: list[str]) -> tuple[list[str], np.ndarray]:
    """The names in order, each once, and where each stands there."""
    ordered = sorted(set(names))
    rank = {name: i for i, name in enumerate(ordered)}
    return ordered, np.array([rank[name] for name in names], np.int64)


def _sweep(laid: _Laid, lo: int, hi: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(place, inset, letters, code, names) of the windows that begin at places lo to hi; names[code] are the choices. Where more than
    CELLS bases would be held, the places are halved; one place is swept however many windows it has."""
    sites, packing = laid.sites, (laid.packed, laid.bits, laid.per)
    a, b = np.searchsorted(sites, (lo, hi))
    plain = np.ones(hi - lo, bool)
    plain[sites[a:b] - lo] = False
    own = np.flatnonzero(plain) + lo
    options = slice(laid.first[a], laid.first[b])
    place = np.concatenate([own, np.repeat(sites[a:b], np.diff(laid.first[a : b + 1]))])
    begin, length = np.concatenate([own, laid.begin[options]]), np.concatenate([np.ones(len(own), np.int64), laid.length[options]])
    code, names = np.concatenate([np.zeros(len(own), np.int64), laid.choice[options] + 1]), ["", *laid.names]  # in order, as all names here
    row, inset = _spread(length)
    insets = int(length.max(initial=1))
    stop, ahead = laid.stops[np.searchsorted(laid.stops, np.arange(lo, hi), "right")], np.searchsorted(sites, np.arange(lo, hi), "right")
    halves, held, most = ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)) if hi - lo > 1 else (), 0, CELLS // k
    if halves and len(row) > most:
        for half in halves:
            yield from _sweep(laid, *half, k)
        return
    text, start = [np.zeros(len(row), np.int64) for _ in range(0, k, laid.per)], (place[row] - lo) * insets + inset
    length = _write(text, np.zeros(len(row), np.int64), *packing, begin[row] + inset, np.minimum(length[row] - inset, k))
    code, passed, done = code[row], 0, []

    def leave(going: np.ndarray) -> None:
        """Puts whole windows by; of the others those stay that go on."""
        nonlocal start, text, length, code, held
        whole = length == k
        if whole.any():
            done.append((start[whole], [word[whole] for word in text], code[whole], names))
            held += int(whole.sum())
        going = going & ~whole
        start, text, length, code = start[going], [word[going] for word in text], length[going], code[going]

    while len(start):
        at = start // insets
        site = ahead[at] + passed
        here = at + lo + 1 if not passed else sites[site - 1] + 1
        nearest = np.append(sites, laid.stops[-1])[site]
        length = _write(text, length, *packing, here, np.minimum(k - length, np.minimum(nearest, stop[at]) - here))
        leave(nearest < stop[at])
        start, text, code = _least(start, text, code, laid.bits * laid.per)
        length = _lengths(text, laid.bits, laid.per)
        site = ahead[start // insets] + passed
        row, number = _spread(laid.first[site + 1] - laid.first[site])
        if halves and held + len(row) > most:
            for half in halves:
                yield from _sweep(laid, *half, k)
            return
        option = laid.first[site][row] + number
        start, text = start[row], [word[row] for word in text]
        length = _write(text, length[row], *packing, laid.begin[option], np.minimum(k - length[row], laid.length[option]))
        pairs, which = np.unique(code[row] * len(laid.names) + laid.choice[option], return_inverse=True)
        longer = [(names[p // len(laid.names)], laid.names[p % len(laid.names)]) for p in pairs.tolist()]
        names, ranks = _named([f"{before},{choice}" if before else choice for before, choice in longer])
        code, passed = ranks[which], passed + 1
        leave(np.ones(len(start), bool))
    if not done:
        return
    names, ranks = _named([name for *_, own in done for name in own])
    base = np.cumsum([0, *(len(own) for *_, own in done)])
    start, text = np.concatenate([d[0] for d in done]), [np.concatenate(words) for words in zip(*(d[1] for d in done))]
    code = np.concatenate([ranks[base[i] + d[2]] for i, d in enumerate(done)])
    start, text, code = _least(start, text, code, laid.bits * laid.per)
    shifts = [laid.bits * (laid.per - 1 - i) for i in range(laid.per)]
    small = np.uint8 if laid.letters.max(initial=0) < 128 else np.uint32
    letters, held = np.empty((len(start), k), small), laid.letters.astype(small)
    for i in range(k):
        letters[:, i] = held[((text[i // laid.per] >> shifts[i % laid.per]) & ((1 << laid.bits) - 1)) - 1]
    yield start // insets + lo, start % insets, letters, code, names


def _strings(letters: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    n, k = letters.shape
    if letters.dtype == np.uint8:
        return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.py_buffer(letters.tobytes()))
    whole = letters.tobytes().decode("utf-32-le")
    return pa.array([whole[i : i + k] for i in range(0, n * k, k)], pa.string())


def windows_from(sequence: str, sites: dict[int, list[tuple[str, str]]], order: list[int], pos: int, k: int) -> Iterator[tuple[int, str, str]]:
    """(inset, window, choices) of the windows that begin at place ``pos``; choice 0 is the sequence's own base."""
    listed = [(at, choice, text) for at in order for choice, text in sites[at] if choice != "0"]
    at, choices, texts = zip(*listed) if listed else ((), (), ())
    laid = _lay([sequence], np.zeros(len(at), np.int64), np.array(at, np.int64), pa.array(choices, pa.string()), pa.array(texts, pa.string()), k)
    for _, inset, letters, code, names in _sweep(laid, pos, pos + 1, k):
        yield from zip(inset.tolist(), _strings(letters).to_pylist(), [names[c] for c in code.tolist()])


def string_windows(sequences: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """(header, pos, inset, kmer, choices): the distinct texts of k bases that begin at base ``inset`` of a text of place ``pos``.

    ``sequences``: header, sequence. ``sites``: header, pos (0-based), choice, text; choice 0 is the sequence's own base and need not
    be given, a null text is empty, places outside the sequence have no effect. ``choices`` leads back to the alternatives: the choice
    at each site from pos to the window's last base, joined by commas; of several walks the least as a string. Windows that the
    sequence's end cuts short are none; null and empty sequences have none. A sequence and its sites are one row's work.
    """
    if k < 1:
        raise ValueError("a window has at least one base")
    width = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number: what follows is work, not bytes
    per = sites.filter("choice > 0 AND pos IS NOT NULL").groupBy(F.col("header").alias("__h")).agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("choice").cast("string").alias("choice"), F.coalesce("text", F.lit("")).alias("text"))).alias("x")).hint("merge")  # else small inputs' sites would pass through the driver
    own = sequences.repartition(width, "header")  # empty ones fall out of the sweep, as a filter would find the sequences a second time
    rows = own.join(per, F.col("header") == F.col("__h"), "left").select(F.col("header").cast("string"), F.coalesce("sequence", F.lit("")).alias("sequence"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            sizes = np.cumsum(pc.utf8_length(given.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), given.num_rows] if given.num_rows else [0]
            for one, other in zip(cuts, cuts[1:]):
                piece = given.slice(one, other - one)
                listed = piece.column(2)
                counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                pos, choice, text = listed.flatten().flatten()
                laid = _lay(piece.column(1).to_pylist(), np.repeat(np.arange(len(counts)), counts), pos.to_numpy(zero_copy_only=False), choice, text, k)
                for lo in range(0, int(laid.stops[-1]), BLOCK):
                    for place, inset, letters, code, names in _sweep(laid, lo, min(lo + BLOCK, int(laid.stops[-1])), k):
                        row = np.searchsorted(laid.stops, place, "right")
                        begin = np.append(0, laid.stops)[row]
                        columns = [piece.column(0).take(pa.array(row)), pa.array(place - begin), pa.array(inset), _strings(letters), pa.array(names, pa.string()).take(pa.array(code))]
                        yield pa.RecordBatch.from_arrays(columns, names=["header", "pos", "inset", "kmer", "choices"])

    return rows.mapInArrow(run, _SCHEMA)
