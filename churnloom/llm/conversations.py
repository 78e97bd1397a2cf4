"""Repair of conversation structure by divide and conquer over four-state cost vectors.

A repaired conversation has the role initials ``(s?(ua)+)?``, so what has been kept so far is in
one of four states: nothing, ``s``, ends in ``u``, ends in ``a``. A row is a step: a 4 x 4 table of
the cheapest edits from each state to each, with the letters of the edits (inserts, then the
row's own letter). Steps compose, so a forward vector holds for each state the least cost from the
start and the rank of the least letters among the four, and a backward vector the least cost to
the end. As every step ends in its only letter that is no insert, no letters of one state begin
those of another, and ranks can be compared before the rest is known.

As in Hirschberg's method the two vectors meet in the middle of the conversation; of the crossings
with the least total the one whose letters are least is taken, and both halves are solved
likewise between known states. Only the vectors are kept, never a table of all rows.

On Spark the rows are dealt by ranges of (conversation, turn), so a conversation with a third of
all rows spans many tasks. A conversation that lies within one range and is not long is solved
where it is. The rest is cut into segments of ``SEGMENT`` rows: a segment is a step too, the
crossings between segments come from these tables alone, some 200 bytes each, and then each segment
is rebuilt between its two states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize

SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after the next user or assistant turn, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end the conversation well, from each state.
CLOSING = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\v\f\r"
_BLANK, _DUPLICATE, _CUT = "blank", "duplicate", "truncated"


@dataclass(frozen=True)
class Step:
    """Least cost from state to state, and what orders equal costs."""

    cost: list[list[int]]
    order: list[list]


def _kept_state(state: int, initial: str) -> int | None:
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return None


def _row_step(initial: str, fault: str | None) -> Step:
    best = [[(FAR, "") for _ in STATES] for _ in STATES]

    def offer(before: int, after: int, cost: int, letters: str) -> None:
        best[before][after] = min(best[before][after], (cost, letters))

    forced = fault in (_BLANK, _DUPLICATE)
    extra = TRUNCATED if fault == _CUT else 0
    for before in STATES:
        state = before
        for inserts in range(3):
            spent, prefix = inserts * INSERT, "I" * inserts
            offer(before, state, spent + DELETE, prefix + "D")
            if not forced:
                kept = _kept_state(state, initial)
                if kept is not None:
                    offer(before, kept, spent + KEEP + extra, prefix + "K")
                offer(before, NEXT[state], spent + REROLE + extra, prefix + "R")
            state = NEXT[state]
    return Step([[c for c, _ in row] for row in best], [[x for _, x in row] for row in best])


_STEPS: dict[tuple[str, str | None], Step] = {}


def row_step(initial: str, fault: str | None) -> Step:
    kind = (initial if initial and initial in "sua" else "", fault)
    if kind not in _STEPS:
        _STEPS[kind] = _row_step(*kind)
    return _STEPS[kind]


Vector = tuple[list[int], list[int]]


def forward(steps: list[Step], low: int, high: int, start: int) -> Vector:
    """Cost of each state after ``steps[low:high]`` from ``start``, and the rank of its letters."""
    costs, ranks = [FAR] * 4, [0] * 4
    costs[start] = 0
    for i in range(low, high):
        cost, order = steps[i].cost, steps[i].order
        found = [
            min(((costs[x] + cost[x][y], ranks[x], order[x][y]) for x in STATES if costs[x] < FAR and cost[x][y] < FAR),
                default=(FAR, 4, order[0][0]))
            for y in STATES
        ]
        placed = sorted({(r, o) for c, r, o in found if c < FAR})
        costs = [c for c, _, _ in found]
        ranks = [placed.index((r, o)) if c < FAR else 4 for c, r, o in found]
    return costs, ranks


def backward(steps: list[Step], low: int, high: int, end: int) -> list[int]:
    """Cost from each state over ``steps[low:high]`` to ``end``."""
    costs = [FAR] * 4
    costs[end] = 0
    for i in range(high - 1, low - 1, -1):
        cost = steps[i].cost
        costs = [min(FAR, *(cost[x][y] + costs[y] for y in STATES)) for x in STATES]
    return costs


def crossings(steps: list[Step]) -> tuple[int, list[int]]:
    """Least cost of a whole conversation, and the states of the least letters."""
    costs, ranks = forward(steps, 0, len(steps), START)
    cost, _, end = min((costs[y] + len(CLOSING[y]) * INSERT, ranks[y], y) for y in STATES)
    return cost, between(steps, START, end)


def between(steps: list[Step], start: int, end: int) -> list[int]:
    """States before, between and after the steps on the way of the least letters."""
    states = [start] * (len(steps) + 1)
    states[-1] = end
    open_ = [(0, len(steps))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        costs, ranks = forward(steps, low, middle, states[low])
        after = backward(steps, middle, high, states[high])
        states[middle] = min((costs[z] + after[z], ranks[z], z) for z in STATES)[2]
        open_ += [(low, middle), (middle, high)]
    return states


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault that a row has."""
    bare = text.rstrip(_SPACE)
    if not bare:
        return _BLANK
    if repeated:
        return _DUPLICATE
    return None if bare[-1] in ".!?" else _CUT


def rebuilt(rows: list[tuple[str, str]], faults: list, states: list[int], last: bool):
    """Letters of the edits, and the repaired turns; with the closing inserts if ``last``."""
    audit, turns = [], []
    for (role, text), fault, before, after in zip(rows, faults, states, states[1:]):
        letters = row_step(role[:1], fault).order[before][after]
        audit.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                turns.append((role, text))
            else:
                turns.append((ROLE[NEXT[before]], "" if letter == "I" else text))
            before = NEXT[before]
    if last:
        before = states[-1]
        for letter in CLOSING[before]:
            audit.append(letter)
            before = NEXT[before]
            turns.append((ROLE[before], ""))
    return "".join(audit), turns


def _illegal(rows: list[tuple[str, str]]) -> int:
    initials = [role[:1] for role, _ in rows]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _whole(rows: list[tuple[str, str]]) -> tuple:
    """Counts, cost, letters and turns of a conversation at hand."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in rows:
        faults.append(fault_of(row[1], row in seen))
        seen.add(row)
    cost, states = crossings([row_step(role[:1], f) for (role, _), f in zip(rows, faults)])
    audit, turns = rebuilt(rows, faults, states, last=True)
    counts = [faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)]
    return (*counts, _illegal(rows), cost, audit, turns)


TURNS = "array<struct<role:string,text:string>>"
REPORT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SOLVED = f"key string, part int, place long, role string, text string, {REPORT}, turns {TURNS}"
_NAMES = ["key", "part", "place", "role", "text", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
_HELD = 512


def _solve_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solved conversations; the rows of those that may go on in another range, or are long."""
    out: list[tuple] = []
    key, rows, place, through, first = None, [], 0, True, True
    part = 0

    def flush():
        nonlocal rows, place
        for role, text in rows:
            out.append((key, part, place, role, text, *[None] * 7))
            place += 1
        rows = []

    def frame():
        table = pd.DataFrame(out, columns=_NAMES, dtype=object)
        out.clear()
        return table

    for batch in batches:
        for k, p, role, text in zip(batch.key, batch.part, batch.role, batch.text):
            if k != key or first:
                if not first and rows and not through:
                    out.append((key, part, None, None, None, *_whole(rows)))
                    rows = []
                elif rows:
                    flush()
                # The first conversation of a range may have begun in another.
                key, part, place, through, first = k, p, 0, first, False
            rows.append((role, text))
            through = through or len(rows) > SEGMENT
            if through and len(rows) >= _HELD:
                flush()
            if len(out) >= _HELD:
                yield frame()
    if rows:  # may go on in the next range
        flush()
    if out:
        yield frame()


def _segment(group: pd.DataFrame) -> tuple[list[tuple[str, str]], list, list[Step]]:
    group = group.sort_values("place")
    rows = list(zip(group.role, group.text))
    faults = [fault_of(text, bool(d)) for text, d in zip(group.text, group.repeated)]
    return rows, faults, [row_step(role[:1], f) for (role, _), f in zip(rows, faults)]


_SUMMARY = (
    "key string, part int, segment long, cost array<long>, order array<int>, blank long, duplicate long, "
    "truncated long, illegal long, head string, tail string"
)


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    rows, faults, steps = _segment(group)
    vectors = [forward(steps, 0, len(steps), x) for x in STATES]
    counts = [faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)]
    row = (
        *group.iloc[0][["key", "part", "segment"]],
        [c for costs, _ in vectors for c in costs],
        [r for _, ranks in vectors for r in ranks],
        *counts, _illegal(rows), rows[0][0][:1], rows[-1][0][:1],
    )
    return pd.DataFrame([row], columns=[c.split()[0] for c in _SUMMARY.split(", ")])


_CROSSED = "key string, part int, segment long, before int, after int, last boolean, cost long, joints long"


def _cross(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "segment"])
    table = lambda values: [list(values[i : i + 4]) for i in range(0, 16, 4)]
    cost, states = crossings([Step(table(c), table(o)) for c, o in zip(group.cost, group.order)])
    joints = sum(a + b not in LEGAL for a, b in zip(group["tail"], list(group["head"])[1:]))
    n = len(group)
    return pd.DataFrame(
        {
            "key": group.key, "part": group.part, "segment": group.segment,
            "before": states[:-1], "after": states[1:],
            "last": [False] * (n - 1) + [True], "cost": cost, "joints": joints,
        }
    )


_PIECE = f"key string, part int, segment long, audit string, turns {TURNS}"


def _rebuild(group: pd.DataFrame) -> pd.DataFrame:
    rows, faults, steps = _segment(group)
    one = group.iloc[0]
    states = between(steps, int(one.before), int(one.after))
    audit, turns = rebuilt(rows, faults, states, bool(one["last"]))
    row = (one.key, one.part, one.segment, audit, turns)
    return pd.DataFrame([row], columns=["key", "part", "segment", "audit", "turns"])


def _hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash for each conversation, of pieces in order; nothing but the hash is kept."""
    key, state, some, out = None, hashlib.sha256(), False, []
    for batch in batches:
        for k, turns in zip(batch.key, batch.turns):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state, some = k, hashlib.sha256(), False
            for turn in turns:
                line = f"{turn['role']}:{turn['text']}"
                state.update((("\n" if some else "") + line).encode())
                some = True
        if len(out) >= _HELD:
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "repaired_sha256"])


@dataclass(frozen=True)
class Repaired:
    """``report``: a row for each conversation; ``turns``: the repaired turns, in pieces.

    ``turns`` has ``key`` (of the report), ``part``, ``segment`` and an array of at most some
    ``SEGMENT`` turns; a conversation is its pieces in the order of ``part`` and ``segment``.
    """

    report: DataFrame
    turns: DataFrame


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """Report and repaired turns of every conversation.

    The report has the conversation's id, ``key``, ``gaps`` (turn numbers missing between the
    least and the greatest), the rows whose first fault is ``blank``, ``duplicate`` or
    ``truncated``, ``illegal`` (neighbouring role initials other than su, ua, au), ``cost`` and
    ``audit`` of the cheapest edits, and ``repaired_sha256``. Rows are ordered by turn, null turns
    first, then by role and text; of equal rows all but the first are duplicates. A null role or
    text counts as one space, so such a text is blank and such a role has to be changed; an empty
    role has no initial and cannot be kept either. Rows with a null id are one conversation. Texts
    are taken whole. Other columns are ignored, whatever their names; an empty table gives an empty
    report.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit(""))
    source = rows.select(
        F.col(conversation).alias("id"),
        key.alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    spans = source.groupBy("key").agg(
        F.min("id").alias("id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    order = ["key", "turn", "role", "text", "uid"]  # the last parts equal rows
    ranges = (
        source.drop("id")
        .withColumn("uid", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", F.spark_partition_id().alias("part"), "role", "text")
    )
    solved = materialize(ranges.mapInPandas(_solve_ranges, _SOLVED), "solved")

    open_ = solved.where("place is not null").select("key", "part", "place", "role", "text")
    open_ = open_.withColumn("same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    firsts = open_.groupBy("key", "same").agg(F.min(F.struct("part", "place")).alias("first"))
    flagged = materialize(
        open_.join(firsts.hint("merge"), ["key", "same"]).select(
            "key",
            "part",
            "place",
            F.floor(F.col("place") / SEGMENT).alias("segment"),
            "role",
            "text",
            (F.struct("part", "place") != F.col("first")).alias("repeated"),
        ),
        "flagged",
    )
    keys = ["key", "part", "segment"]
    summaries = materialize(flagged.groupBy(*keys).applyInPandas(_summary, _SUMMARY), "summaries")
    crossed = materialize(
        summaries.select(*keys, "cost", "order", "head", "tail").groupBy("key").applyInPandas(_cross, _CROSSED),
        "crossed",
    )
    pieces = materialize(
        flagged.join(crossed.select(*keys, "before", "after", "last").hint("merge"), keys)
        .groupBy(*keys)
        .applyInPandas(_rebuild, _PIECE),
        "pieces",
    )
    counted = summaries.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    totals = crossed.where("last").select("key", "cost", "joints")
    letters = pieces.groupBy("key").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "segment", "audit"))), lambda p: p["audit"]), ""
        ).alias("audit")
    )
    hashes = (
        pieces.select(*keys, "turns").repartition("key").sortWithinPartitions(*keys)
        .mapInPandas(_hash_pieces, "key string, repaired_sha256 string")
    )
    found = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    spread = (
        counted.join(totals, "key").withColumn("illegal", F.col("illegal") + F.col("joints"))
        .join(letters, "key").join(hashes, "key").select(*found)
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = solved.where("place is null")
    alone = whole.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).select(*found)
    report = spans.join(alone.unionByName(spread), "key").select(
        F.col("id").alias(conversation), "key", "gaps", *found[1:]
    )
    turns = whole.select("key", "part", F.lit(0).cast("long").alias("segment"), "turns").unionByName(
        pieces.select(*keys, "turns")
    )
    return Repaired(report, turns)


def damaged(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The four columns, damaged by h = crc32(``conversation:turn``) % 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes away its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    its role user. A null id or turn is one space in the hashed text only.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(conversation), F.lit(":"), space(turn)).cast("binary")) % 20
    value = F.when(h == 1, "").when(h == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.where(h != 0)
        .select(
            F.col(conversation).alias("_conversation"),
            F.col(turn).alias("_turn"),
            F.when(h == 4, "user").otherwise(space(role)).alias("_role"),
            value.alias("_text"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
        .toDF(conversation, turn, role, text)
    )


def repair_damaged(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The report on the damaged rows, for every conversation of the table; digest columns only."""
    found = repair(damaged(rows)).report.withColumnRenamed(conversation, "_found")
    every = rows.select(conversation).distinct()
    joined = every.join(found, F.col(conversation).eqNullSafe(F.col("_found")) & found.key.isNotNull(), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        conversation,
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
