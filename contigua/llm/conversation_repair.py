"""Conversation repair: the cheapest edits that make roles alternate, by the tight arcs of a layered graph.

A node is (turns read, state): nothing yet, after a system turn, after a user turn, after an assistant turn. Arcs are edits: keep
a turn, give it the role that fits, delete it, insert an empty one. Costs from the start forward and from the end backward tell
which arcs lie on some cheapest way: those with forward + arc + backward = least. From the start, the set of nodes reached by the letters so far
(the frontier) goes on by the least letter among its tight arcs until it holds an end, which gives the least audit of all
cheapest ones. Inserting costs, so the tight arcs have no cycle.

Conversations of at most ``most_turns`` turns and ``most_chars`` characters are solved where they lie after one shuffle. Longer
ones are range-partitioned by (conversation, turn) into pieces of about that size: each piece's costs between states are a 4 x 4 matrix, the
matrices of a conversation folded in order give the costs at its cuts from both sides, each piece is walked from every state, and
a second fold picks the states passed. A repeated turn is found by the least place of its 128-bit key, counted before it is shuffled.

Defined results: null roles and texts are a space; turns of a conversation go by turn, nulls first, then role and text, and equal
rows are repeated turns; a null conversation id is a conversation; texts are read whole; a conversation without turns needs no edit;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from contigua.llm.common import row_key, sized, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
OFF = 1 << 60
#: State after a role's initial; a role fits a state if there is one.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a new or changed turn takes in a state.
FITS = ("user", "user", "assistant", "user")
ENDS = (0, 3)
STOPS = ".!?"
LEGAL = ("su", "ua", "au")


# -- one run of turns ---------------------------------------------------------------------------------

Turn = tuple[str, bool, bool]  # initial of the role, must go, truncated


def arcs_of(turn: Turn) -> list[tuple[int, str, int, int]]:
    """(state, letter, cost, state after) of the edits that read the turn."""
    initial, gone, cut = turn
    out = [(q, DELETE, COST[DELETE], q) for q in range(4)]
    if not gone:
        out += [(q, KEEP, COST[KEEP] + cut, AFTER[q, initial]) for q in range(4) if (q, initial) in AFTER]
        out += [(q, REROLE, COST[REROLE] + cut, AFTER[q, FITS[q][0]]) for q in range(4)]
    return out


_ARCS: dict[Turn, list[tuple[int, str, int, int]]] = {(i, g, c): arcs_of((i, g, c)) for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)}
_INSERTS = [(q, INSERT, COST[INSERT], AFTER[q, FITS[q][0]]) for q in range(4)]


def _arcs(turn: Turn) -> list[tuple[int, str, int, int]]:
    return _ARCS.get(turn) or _ARCS["", turn[1], turn[2]]


def _inserted(costs: list[int], ahead: bool) -> list[int]:
    for _ in range(2):  # two inserts reach every state that any number reaches
        for q, _l, c, to in _INSERTS:
            one, other = (q, to) if ahead else (to, q)
            costs[other] = min(costs[other], costs[one] + c)
    return costs


def forward(turns: list[Turn], start: list[int]) -> list[list[int]]:
    out = [_inserted(list(start), True)]
    for turn in turns:
        now, after = out[-1], [OFF] * 4
        for q, _l, c, to in _arcs(turn):
            if now[q] + c < after[to]:
                after[to] = now[q] + c
        out.append(_inserted(after, True))
    return out


def backward(turns: list[Turn], end: list[int]) -> list[list[int]]:
    out = [_inserted(list(end), False)]
    for turn in reversed(turns):
        now, before = out[-1], [OFF] * 4
        for q, _l, c, to in _arcs(turn):
            if now[to] + c < before[q]:
                before[q] = now[to] + c
        out.append(_inserted(before, False))
    return out[::-1]


def walk(turns: list[Turn], start: set[int], ahead: list[list[int]], back: list[list[int]], last: bool) -> tuple[str, set[int]]:
    """(letters, states at the end): from the frontier ``start`` by the least letter over tight arcs. Of a run that goes on, the walk ends with its
    last turn; inserts behind it belong to the next."""
    least = min(ahead[0][q] + back[0][q] for q in start)
    letters, i, at, n = [], 0, set(start), len(turns)
    while True:
        if i == n and (not last or any(q in ENDS and ahead[n][q] == least for q in at)):
            return "".join(letters), at
        reached: dict[str, set[int]] = {}
        for q in at:
            for a, letter, c, to in _INSERTS:
                if a == q and ahead[i][q] + c + back[i][to] == least:
                    reached.setdefault(letter, set()).add(to)
            if i < n:
                for a, letter, c, to in _arcs(turns[i]):
                    if a == q and ahead[i][q] + c + back[i + 1][to] == least:
                        reached.setdefault(letter, set()).add(to)
        letter = min(reached)
        letters.append(letter)
        i, at = i + (letter != INSERT), reached[letter]


def applied(letters: str, turns: list[tuple[str, str]], state: int) -> list[dict[str, str]]:
    """The turns that stay, with their roles, from a state on."""
    out, i = [], 0
    for letter in letters:
        role, text = turns[i] if letter != INSERT else ("", "")
        i += letter != INSERT
        if letter == DELETE:
            continue
        role = role if letter == KEEP else FITS[state]
        state = AFTER[state, role[:1]]
        out.append({"role": role, "text": text})
    return out


def repaired(turns: list[Turn]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    ahead, back = forward(turns, [0, OFF, OFF, OFF]), backward(turns, [0, OFF, OFF, 0])
    return back[0][0], walk(turns, {0}, ahead, back, True)[0]


def faults(text: str) -> tuple[bool, bool]:
    """(blank, truncated)."""
    seen = text.rstrip("\x20\t\n\x0b\x0c\r")
    return not seen, bool(seen) and seen[-1] not in STOPS


# -- damage ---------------------------------------------------------------------------------------------


def plain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there): null roles and texts as a space; all rows are there."""
    c = lambda name, kind: F.col(name).cast(kind)
    return conversations.select(c(conv_col, "long").alias("conv_id"), c(turn_col, "long").alias("turn"), F.coalesce(c(role_col, "string"), F.lit(" ")).alias("role"), F.coalesce(c(text_col, "string"), F.lit(" ")).alias("text"), F.lit(True).alias("there"))


def damaged(turns: DataFrame) -> DataFrame:
    """Of the hash of (conversation, turn), one in twenty each: the row goes (not ``there``), its text is emptied or loses its stops, it is repeated, it
    becomes the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    text = F.when(F.col("__hit") == 1, "").when(F.col("__hit") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("__hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.withColumn("__hit", hit).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("there") & (F.col("__hit") != 0)).alias("there"), F.explode(times).alias("__copy"))
    return rows.drop("__copy")


# -- the operator -----------------------------------------------------------------------------------------

PIECE = (
    "conv_id long, piece long, pieces long, turns_min long, turns_max long, turns_distinct long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired array<struct<role:string,text:string>>"
)
_TYPES = [*[pa.int64()] * 11, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
_NAMES = "conv_id piece pieces turns_min turns_max turns_distinct blank duplicate truncated illegal cost audit repaired".split()


_FOLDED = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in ("conv_id", *_NAMES[3:12])] + [("repaired_sha256", pa.string())])


def _initials(roles: list[str]) -> int:
    firsts = [r[:1] for r in roles]
    return sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:]))


def _solved(conv: int | None, rows: list[tuple]) -> tuple:
    """A whole conversation; rows are (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    turns: list[Turn] = []
    for _, role, text in rows:
        blank, cut = faults(text)
        again = (role, text) in seen
        seen.add((role, text))
        kind = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if kind:
            counts[kind] += 1
        turns.append((role[:1], blank or again, cut and not blank))
    cost, audit = repaired(turns)
    numbers = {t for t, _, _ in rows if t is not None}
    ends = (min(numbers), max(numbers)) if numbers else (None, None)
    return (conv, 0, 1, *ends, len(numbers), counts["blank"], counts["duplicate"], counts["truncated"], _initials([r for _, r, _ in rows]), cost, audit, applied(audit, [(r, t) for _, r, t in rows], 0))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, a conversation whole in the partition."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out, held = [], 0
    for conv, own in groupby(rows(), key=lambda r: r[0]):
        out.append(_solved(conv, [r[1:4] for r in own if r[4]]))
        held += sum(len(t["text"]) for t in out[-1][-1]) + 64
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


def _order(conversation: Column) -> list[Column]:
    return [conversation, F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(turns: DataFrame, most_turns: int = 20_000, most_chars: int = 64 << 20) -> DataFrame:
    """The columns of ``PIECE``, from rows (conv_id, turn, role, text, there): a row a conversation, or several, ``piece`` by ``piece``, where it is long.
    Sums over pieces are the conversation's figures (``turns_distinct`` counts a turn in the piece of its first row)."""
    whole, pieces = _both(turns, most_turns, most_chars)
    return whole if pieces is None else whole.unionByName(pieces)


def _both(turns: DataFrame, most_turns: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Conversations solved as a whole, and long ones in pieces if there are any."""
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = stored(size.filter((F.col("n") > most_turns) | ((F.col("chars") > most_chars) & (F.col("n") > 1))).select(F.col("conv_id").alias("__long"), "n", "chars"))
    some = long.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    short, same = turns, F.col("conv_id").eqNullSafe(F.col("__long"))
    if some.n:
        names = sized(long.select("__long"))
        short = turns.join(names, same, "left_anti")
    solved = short.select("conv_id", "turn", "role", "text", "there").repartition("conv_id").sortWithinPartitions(*_order(F.col("conv_id"))).mapInArrow(_short, PIECE)
    if not some.n:
        return solved, None
    width = int(max(some.n // most_turns, (some.chars or 0) // most_chars)) + 1
    return solved, _long(turns.join(names, same, "left_semi"), width)


def _long(turns: DataFrame, width: int) -> DataFrame:
    """Conversations in pieces, of which there are about ``width`` in all."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c")  # never null
    rows = turns.filter("there").select("conv_id", key, "turn", "role", "text", *row_key(F.col("role"), F.col("text")))
    dealt = rows.repartitionByRange(width, F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)).sortWithinPartitions(*_order(F.col("c")))
    held = stored(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    first = held.groupBy("c", "k1", "k2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    ink = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    marked = held.join(first, "place", "left").withColumn("blank", ink == "").withColumn("again", F.col("first").isNull())
    marked = stored(marked.withColumn("cut", (ink != "") & ~F.right(ink, F.lit(1)).isin(*STOPS)).drop("first"))
    turn_first = Window.partitionBy("c", "turn").orderBy("part")
    numbers = marked.filter("turn IS NOT NULL").groupBy("c", "turn", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(turn_first)).filter("r = 1")
    numbers = numbers.groupBy("c", "part").agg(F.count(F.lit(1)).alias("distinct"))
    slim = marked.select("c", "part", "place", F.substring("role", 1, 1).alias("initial"), "blank", "again", "cut")

    def listed(pdf: pd.DataFrame) -> list[Turn]:
        pdf = pdf.sort_values("place")
        return [(i, b or a, c) for i, b, a, c in zip(pdf["initial"], pdf["blank"], pdf["again"], pdf["cut"])]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        turns = listed(pdf)
        table = [forward(turns, [0 if q == s else OFF for q in range(4)])[-1] for s in range(4)]
        initials = [t[0] for t in turns]
        inner = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return pd.DataFrame({"c": [pdf["c"].iloc[0]], "part": [pdf["part"].iloc[0]], "costs": [[min(v, OFF) for row in table for v in row]], "head": [initials[0]], "tail": [initials[-1]], "inner": [inner]})

    pieces = stored(slim.groupBy("c", "part").applyInPandas(summary, "c string, part int, costs array<long>, head string, tail string, inner long"))

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        """Costs at both ends of each piece, the number of pieces, and pairs of roles across cuts."""
        pdf = pdf.sort_values("part").reset_index(drop=True)
        tables = [[list(c[4 * s : 4 * s + 4]) for s in range(4)] for c in pdf["costs"]]
        ahead, back = [[0, OFF, OFF, OFF]], [[0, OFF, OFF, 0]]
        for t in tables:
            ahead.append([min(OFF, *(ahead[-1][s] + t[s][q] for s in range(4))) for q in range(4)])
        for t in reversed(tables):
            end = _inserted(list(back[-1]), False)
            back.append([min(OFF, *(t[q][s] + end[s] for s in range(4))) for q in range(4)])
        back = back[::-1]
        across = [0, *(int(a + b not in LEGAL) for a, b in zip(pdf["tail"], pdf["head"][1:]))]
        n = len(pdf)
        return pd.DataFrame({"c": pdf["c"], "part": pdf["part"], "ahead": ahead[:n], "back": back[1:], "least": [back[0][0]] * n, "piece": range(n), "pieces": [n] * n, "illegal": pdf["inner"] + across})

    ends = stored(pieces.groupBy("c").applyInPandas(cuts, "c string, part int, ahead array<long>, back array<long>, least long, piece long, pieces long, illegal long"))

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Letters and the state after them from each state on a cheapest way."""
        turns, last = listed(pdf), pdf["piece"].iloc[0] + 1 == pdf["pieces"].iloc[0]
        ahead, back, least = forward(turns, list(pdf["ahead"].iloc[0])), backward(turns, list(pdf["back"].iloc[0])), pdf["least"].iloc[0]
        ways = [walk(turns, {q}, ahead, back, last) if ahead[0][q] + back[0][q] == least else ("", {-1}) for q in range(4)]
        return pd.DataFrame({"c": [pdf["c"].iloc[0]], "part": [pdf["part"].iloc[0]], "letters": [[w[0] for w in ways]], "after": [[min(w[1]) for w in ways]]})

    ways = stored(slim.join(ends, ["c", "part"]).groupBy("c", "part").applyInPandas(walked, "c string, part int, letters array<string>, after array<int>"))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, states = pdf.sort_values("part"), 0, []
        for after in pdf["after"]:
            states.append(state)
            state = after[state]
        return pd.DataFrame({"c": pdf["c"], "part": pdf["part"], "state": states})

    states = ways.select("c", "part", "after").groupBy("c").applyInPandas(chosen, "c string, part int, state int")
    picked = ways.join(states, ["c", "part"]).select("c", "part", "state", F.element_at("letters", F.col("state") + 1).alias("audit"))
    figures = ends.select("c", "part", "piece", "pieces", "illegal", "least").join(picked, ["c", "part"]).join(numbers, ["c", "part"], "left").drop("ahead", "back")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        one = pdf.iloc[0]
        numbers = [int(t) for t in pdf["turn"].dropna()]
        blank, again, cut = pdf["blank"], pdf["again"], pdf["cut"]
        return pd.DataFrame({
            "conv": [one["conv"]], "piece": [one["piece"]], "pieces": [one["pieces"]], "turns_min": pd.array([min(numbers, default=None)], "Int64"), "turns_max": pd.array([max(numbers, default=None)], "Int64"),
            "turns_distinct": [one["distinct"]], "blank": [blank.sum()], "duplicate": [(again & ~blank).sum()], "truncated": [(cut & ~again).sum()], "illegal": [one["illegal"]], "cost": [one["least"] if one["piece"] == 0 else 0],
            "audit": [one["audit"]], "repaired": [applied(one["audit"], list(zip(pdf["role"], pdf["text"])), int(one["state"]))],
        })

    whole = marked.join(figures, ["c", "part"]).select("c", "part", "place", F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("decimal(20,0)").alias("turn"), "role", "text", "blank", "again", "cut", "piece", "pieces", F.coalesce("distinct", F.lit(0)).alias("distinct"), "illegal", "least", "audit", "state")
    done = whole.groupBy("c", "part").applyInPandas(final, PIECE.replace("conv_id long", "conv string"))
    done = done.select(F.col("conv").cast("long").alias("conv_id"), *_NAMES[1:])
    empty = turns.groupBy("conv_id", key).agg(F.max("there").alias("any")).filter("NOT any").select("conv_id")  # all of its turns are gone
    none = [F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.lit(0).cast("long")] * 6, F.lit(""), F.expr("cast(array() as array<struct<role:string,text:string>>)")]
    return done.unionByName(empty.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), *(c.alias(n) for c, n in zip(none, _NAMES[3:]))))


def digests(turns: DataFrame, most_turns: int = 20_000, most_chars: int = 64 << 20) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations solved as a whole are digested where they are. The pieces of a longer one pass in order through one task, a piece at a time: SHA-256 has no
    other way.
    """
    whole, pieces = _both(turns, most_turns, most_chars)
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.greatest(F.col("turns_max").cast("decimal(38,0)") - F.col("turns_min") + 1 - F.col("turns_distinct"), F.lit(0)), F.lit(0))
    out = ["conv_id", F.least(gaps, F.lit((1 << 63) - 1)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    one = whole.withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256)).select(*out)
    if pieces is None:
        return one

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from batch.to_pylist()

        for conv, own in groupby(each(), key=lambda r: r["conv_id"]):
            sha, audit, begun, total = hashlib.sha256(), [], False, dict.fromkeys(_NAMES[5:11], 0)
            low = high = None
            for r in own:
                if r["kept"]:
                    sha.update((b"\n" if begun else b"") + r["lines"].encode("utf-8", "surrogatepass"))
                    begun = True
                audit.append(r["audit"])
                low, high = (f((v for v in (a, r[k]) if v is not None), default=None) for f, a, k in ((min, low, "turns_min"), (max, high, "turns_max")))
                for k in total:
                    total[k] += r[k]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "turns_min": low, "turns_max": high, **total, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=_FOLDED)

    lines = pieces.select("conv_id", "piece", *_NAMES[3:12], text.alias("lines"), F.size("repaired").alias("kept"))
    folded = lines.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(fold, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _FOLDED))
    return one.unionByName(folded.select(*out))
