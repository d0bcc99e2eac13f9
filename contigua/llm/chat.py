"""Chat formatting: a hidden Markov model reads roles from transcripts, Viterbi decodes, turns are rendered.

A transcript is plain text. Each line is observed through features: the kind of speaker marker at its
start, whether it is blank, ends as a question, begins in lower case, and its length class. The hidden
states are (role, first line of a turn or a later one). Transitions and emissions are counted from
conversations with known roles (features independent given the state, add-half smoothing) over all
labelled rows: the counts are a few hundred numbers whatever the input. Viterbi gives each line a state;
lines of a turn are joined, a marker that the decoded role explains is removed, and turns are rendered
as ``<|role|>\\n...<|end|>``.

Conversations are range-partitioned by (conversation, turn) and cut into segments of at most ``SEGMENT`` turns and
``SEGMENT_CHARS`` characters, so one of any length is many tasks'. Decoding is that of the whole transcript all the same: a segment's best
scores from each state before it to each of its last states are a 6 x 6 matrix; the matrices of a conversation, combined in
order (maximum of sums), give the states at its cuts, and between fixed states each segment is decoded apart. A turn that goes
on across a cut is rendered in pieces, so that pieces in order (segment, position) are the transcript.

``format_chats`` trains two models, each on half of the conversations by hash, and reads each conversation by the one that
has not seen it; of the transcripts' turns one in ``blur`` has no marker and one in ``blur`` one of an unknown name.

Defined results: an empty or null transcript has no turns; a turn without text is one blank line of its
speaker; a null or unknown role has no marker, and the model decides; a null conversation id is a conversation, a
null turn comes first; turns of equal number go by role and a hash of the text, and repeated rows are repeated turns; ties between
paths go to the first state in order; an empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from contigua.llm.common import shuffle_width, stored

ROLES = ("system", "user", "assistant")
#: (role, begins a turn)
STATES = tuple((r, b) for r in ROLES for b in (True, False))
SEGMENT, SEGMENT_CHARS = 4096, 1 << 20
#: What a role's marker counts in its favour before anything is seen.
PRIOR = 4.0
#: How transcripts name speakers.
MARKERS = {
    "system": ("system", "sys", "context", "instructions"),
    "user": ("user", "human", "question", "customer", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "model", "a"),
}
_KIND = {name: kind for kind, names in MARKERS.items() for name in names}
_MARKER = regex.compile(r"^\s*(?:#{1,6}\s*|\*\*|\[|<\|?)?(\p{L}[\p{L}_ ]{0,19}?)(?:\*\*:|:\*\*|\|?>:?|\]:?|:)\s*", regex.IGNORECASE)


def marker(line: str) -> tuple[str, int]:
    """(kind, end of the marker): the role that it names, ``other`` for an unknown name, ``none``."""
    hit = _MARKER.match(line)
    if not hit:
        return "none", 0
    return _KIND.get(hit[1].strip().lower(), "other"), hit.end()


def features(line: str) -> tuple[str, str, str, str, str]:
    kind, at = marker(line)
    rest = line[at:].strip()
    size = "0" if not rest else "s" if len(rest) < 40 else "m" if len(rest) < 200 else "l"
    return f"marker={kind}", f"blank={not line.strip()}", f"asks={rest.endswith('?')}", f"lower={rest[:1].islower()}", f"size={size}"


FEATURE_VALUES = {"marker": 5, "blank": 2, "asks": 2, "lower": 2, "size": 4}


class RoleModel:
    """Log-probabilities from counts ``{(what, state or previous, value): n}``."""

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        names = [f"{r}/{'first' if b else 'later'}" for r, b in STATES]
        n = len(names)
        self.start, self.step = np.full(n, 0.5), np.full((n, n), 0.5)
        self.emit: list[dict[str, float]] = []
        for i, a in enumerate(names):
            self.start[i] = counts.get(("start", "", a), 0) + 0.5 if STATES[i][1] else 1e-6
            for j, b in enumerate(names):
                same_turn = STATES[j][0] == STATES[i][0] and not STATES[j][1]
                self.step[i, j] = counts.get(("step", a, b), 0) + 0.5 if STATES[j][1] or same_turn else 1e-9  # a later line stays with its role
            seen = {v: c for (what, s, v), c in counts.items() if what == "emit" and s == a}
            if STATES[i][1]:
                known = f"marker={STATES[i][0]}"
                seen[known] = seen.get(known, 0) + PRIOR
            total = {f: sum(c for v, c in seen.items() if v.startswith(f + "=")) for f in FEATURE_VALUES}
            self.emit.append({"": 0.0} | {v: float(np.log((c + 0.5) / (total[v.split("=")[0]] + 0.5 * FEATURE_VALUES[v.split("=")[0]]))) for v, c in seen.items()})
            self.emit[-1] |= {f"{f}?": float(np.log(0.5 / (total[f] + 0.5 * k))) for f, k in FEATURE_VALUES.items()}
        self.start = np.log(self.start / self.start.sum())
        self.step = np.log(self.step / self.step.sum(1, keepdims=True))

    def _seen(self, lines: list[str]) -> list[list[float]]:
        return [[sum(e.get(v, e[v.split("=")[0] + "?"]) for v in fs) for e in self.emit] for fs in map(features, lines)]

    def reach(self, lines: list[str], begins: bool) -> tuple[np.ndarray, np.ndarray]:
        """Best scores by (state before, last state), and the first state of each such path; of lines that begin a transcript one row."""
        seen = np.array(self._seen(lines))
        score = (self.start[None, :] if begins else self.step) + seen[0]
        first = np.broadcast_to(np.arange(len(STATES)), score.shape)
        for own in seen[1:]:
            ways = score[:, :, None] + self.step[None]
            best = ways.argmax(1)
            score, first = np.take_along_axis(ways, best[:, None], 1)[:, 0] + own, np.take_along_axis(first, best, 1)
        return score, first.astype(np.int8)

    def decode(self, lines: list[str], before: int | None = None, last: int | None = None) -> list[int]:
        """The most probable states, after the state ``before`` (none: at the beginning) and with ``last`` (none: any) as the last."""
        if not lines:
            return []
        seen = self._seen(lines)
        score, back = (self.start if before is None else self.step[before]) + seen[0], []
        for own in seen[1:]:
            reach = score[:, None] + self.step
            best = reach.argmax(0)
            back.append(best)
            score = reach[best, np.arange(len(STATES))] + own
        path = [int(score.argmax()) if last is None else last]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return path[::-1]

    def parse(self, transcript: str | None) -> list[tuple[str, str, int]]:
        """(role, text, lines) of each turn."""
        lines = transcript.split("\n") if transcript else []
        return [(role, text, n) for role, text, n, _ in turns_of(lines, self.decode(lines))]


def turns_of(lines: list[str], states: list[int], before: int | None = None) -> list[tuple[str, str, int, bool]]:
    """(role, text, lines, whether it goes on from ``before``) of each turn."""
    turns: list[list] = []
    for line, s in zip(lines, states):
        role, first = STATES[s]
        kind, at = marker(line)
        goes_on = not first and (bool(turns) and turns[-1][0] == role or not turns and before is not None and STATES[before][0] == role)
        if goes_on and turns:
            turns[-1][1].append(line)
        else:
            turns.append([role, [line[at:] if kind == role and not goes_on else line], goes_on])
    return [(role, "\n".join(own).strip(), len(own), goes_on) for role, own, goes_on in turns]


def boundaries(reaches: list[np.ndarray]) -> list[int]:
    """The last state of each segment on the best path through all of them."""
    score, back = reaches[0][0], []
    for m in reaches[1:]:
        way = score[:, None] + m
        back.append(way.argmax(0))
        score = way.max(0)
    path = [int(score.argmax())]
    for best in reversed(back):
        path.append(int(best[path[-1]]))
    return path[::-1]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


#: The ways in which a speaker is marked here.
STYLES = ("{}: ", "[{}] ", "### {}: ", "**{}:** ", "<|{}|> ")


def marked(role: str | None, text: str | None, key: int, blur: int = 0) -> str:
    """A turn as a transcript writes it; which name and style, and whether it has any, is a function of ``key``."""
    if role not in MARKERS:
        return text or ""
    if blur and key // 64 % blur < 2:
        return ("", "Participant: ")[key // 64 % blur] + (text or "")
    names = [n for n in MARKERS[role] if len(n) > 1]
    name = names[key % len(names)]
    return STYLES[key // 7 % len(STYLES)].format(name.capitalize() if key % 2 else name) + (text or "")


def line_counts(turns: list[tuple[str, str]]) -> tuple[dict[tuple[str, str, str], float], str, str]:
    """Counts of a stretch of turns (role, marked text) that are known, without how it begins; its first and last state."""
    out: dict[tuple[str, str, str], float] = {}

    def add(*key: str) -> None:
        out[key] = out.get(key, 0) + 1

    names: list[str] = []
    for role, text in turns:
        for i, line in enumerate(text.split("\n")):
            names.append(f"{role}/{'later' if i else 'first'}")
            for v in features(line):
                add("emit", names[-1], v)
    for a, b in pairwise(names):
        add("step", a, b)
    return out, names[0] if names else "", names[-1] if names else ""


def _key(conv: int | None, turn: int | None) -> int:
    return xxhash.xxh64_intdigest(f"{conv} {turn}") >> 1


SEGMENTS = "conv long, part int, seg int, fold int, turns array<struct<turn:bigint,role:string,text:string>>"


def segments(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """SEGMENTS, stored: a conversation's turns are in order of (part, seg), then of the list."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("conv", "turn", "role", "text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64("conv"), F.lit(2)).cast("int").alias("fold"))
    order = ("conv", "turn", "role", "h")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        turns: list[dict] = []
        seg = size = 0
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=["conv", "part", "seg", "fold", "turns"])

        for batch in batches:
            for conv, turn, role, text, fold in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                if held is not None and (held != (conv, fold) or len(turns) == SEGMENT or size >= SEGMENT_CHARS):
                    out.append((held[0], part, seg, held[1], turns))
                    seg = seg + 1 if held == (conv, fold) else 0
                    turns, size = [], 0
                held = (conv, fold)
                turns.append({"turn": turn, "role": role, "text": text})
                size += len(text or "") + 1
            yield batch_of(out)
            out = []
        if turns:
            yield batch_of([(held[0], part, seg, held[1], turns)])

    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(cut, SEGMENTS))


def train_on(parts: DataFrame, blur: int = 0) -> RoleModel:
    """From all turns with a known role of some ``segments``. What reaches the driver is one row a kind of count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, str], float] = {}
        ends: list[tuple] = []

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 7, types)], names=["what", "state", "value", "n", "conv", "part", "seg"])

        for batch in batches:
            for conv, part, seg, _, turns in zip(*(c.to_pylist() for c in batch.columns)):
                known = [(t["role"], marked(t["role"], t["text"], _key(conv, t["turn"]), blur)) for t in turns if t["role"] in MARKERS]
                counts, first, last = line_counts(known)
                for key, n in counts.items():
                    total[key] = total.get(key, 0) + n
                if known:
                    ends.append(("ends", first, last, 1.0, conv, part, seg))
            yield rows_of(ends)
            ends = []
        yield rows_of([(*k, n, None, None, None) for k, n in total.items()])

    rows = stored(parts.mapInArrow(run, "what string, state string, value string, n double, conv long, part int, seg int"))
    before = F.lag("value").over(Window.partitionBy("conv").orderBy("part", "seg"))
    cuts = rows.filter("what = 'ends'").select(F.coalesce(before, F.lit("")).alias("before"), F.col("state").alias("value"))
    cuts = cuts.select(F.when(F.col("before") == "", "start").otherwise("step").alias("what"), F.col("before").alias("state"), "value", F.lit(1.0).alias("n"))
    counts = rows.filter("what <> 'ends'").select("what", "state", "value", "n").unionByName(cuts)
    return RoleModel({(r.what, r.state, r.value): r.n for r in counts.groupBy("what", "state", "value").agg(F.sum("n").alias("n")).collect()})


def train(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", blur: int = 0) -> RoleModel:
    """From all rows with a known role."""
    return train_on(segments(conversations, conv_col, turn_col, role_col, text_col), blur)


def format_chats(conversations: DataFrame, model: RoleModel | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", blur: int = 8) -> DataFrame:
    """Transcripts of the conversations, read back: ``conv_id``, ``segment``, ``position``, ``role``, ``n_lines``, ``goes_on``, ``rendered``.

    ``role_col`` only decides how a turn is marked in the transcript; the roles returned are decoded. Without a ``model``, by two
    that are trained here, of which each reads what the other learnt from. ``goes_on``: the piece continues the turn before it.
    """
    spark = conversations.sparkSession
    parts = segments(conversations, conv_col, turn_col, role_col, text_col)
    models = [model, model] if model else [train_on(parts.filter(F.col("fold") != f), blur) for f in (0, 1)]
    sent = spark.sparkContext.broadcast(models)
    many = stored(parts.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("many")))
    long = parts.join(many, F.col("conv").eqNullSafe(F.col("many")), "left_semi")

    def lines_of(conv: int | None, turns: list[dict]) -> list[str]:
        return "\n".join(marked(t["role"], t["text"], _key(conv, t["turn"]), blur) for t in turns).split("\n")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, inside = [], []
            for conv, fold, turns in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                lines = lines_of(conv, turns)
                begins.append(b"".join(x.tobytes() for x in sent.value[fold].reach(lines, True)))
                inside.append(b"".join(x.tobytes() for x in sent.value[fold].reach(lines, False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(begins, pa.binary()), pa.array(inside, pa.binary())], names=["conv", "part", "seg", "begins", "inside"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one conversation's segments, some 400 bytes each."""
        pdf = pdf.sort_values(["part", "seg"])
        n = len(STATES)
        raw = [b if i == 0 else m for i, (b, m) in enumerate(zip(pdf["begins"], pdf["inside"]))]
        last = boundaries([np.frombuffer(x, np.float64, len(x) // 9).reshape(-1, n) for x in raw])
        first = [None] + [int(np.frombuffer(x, np.int8, n * n, 8 * n * n).reshape(n, n)[a, b]) for x, a, b in zip(raw[1:], last, last[1:])]
        goes_on = [f is not None and not STATES[f][1] and STATES[f][0] == STATES[b][0] for f, b in zip(first, [0, *last])]
        return pd.DataFrame({"c": pdf["conv"], "p": pdf["part"], "s": pdf["seg"], "segment": range(len(last)), "before": [-1, *last[:-1]], "last": last, "final": [not g for g in [*goes_on[1:], False]]})

    linked = long.mapInArrow(reach, "conv long, part int, seg int, begins binary, inside binary").groupBy("conv").applyInPandas(link, "c long, p int, s int, segment long, before int, last int, final boolean")
    linked = stored(linked)
    same = parts["conv"].eqNullSafe(linked["c"]) & (parts["part"] == linked["p"]) & (parts["seg"] == linked["s"])
    ready = parts.join(linked, same, "left").select("conv", "fold", "turns", F.coalesce("segment", F.lit(0)).cast("long").alias("segment"), "before", "last", F.coalesce("final", F.lit(True)).alias("final"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, fold, turns, segment, before, last, final in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(conv, turns)
                if lines == [""] and len(turns) == 1 and final and before is None and turns[0]["role"] not in MARKERS:
                    continue  # an empty transcript
                before = None if before is None or before < 0 else before
                found = turns_of(lines, sent.value[fold].decode(lines, before, last), before)
                for i, (role, text, n, goes_on) in enumerate(found):
                    whole = render([(role, text)])
                    piece = whole[len(f"<|{role}|>\n") :] if goes_on else whole
                    if i == len(found) - 1 and not final:  # it goes on in the next segment
                        piece = piece.removesuffix("<|end|>\n")
                    out.append((conv, segment, i, role, n, goes_on, piece))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=["conv_id", "segment", "position", "role", "n_lines", "goes_on", "rendered"])

    return ready.mapInArrow(run, "conv_id long, segment long, position long, role string, n_lines long, goes_on boolean, rendered string")
