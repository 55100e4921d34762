"""Chat formatting: minimum-cost repair of roles by dynamic programming.

Legal turns form an automaton: start -> system | user, system -> user, user -> assistant,
assistant -> user; a conversation ends after assistant.  Each turn is either merged into
the message before it or becomes a message of some role, after as many empty messages as
the automaton needs; each deviation has a cost, and the cheapest whole repair is chosen
and rendered.  Among equally cheap ones the first in a fixed order of actions wins.

Turns lie range-partitioned by (conversation, turn), so a conversation may span many
partitions.  A stretch of turns is a (min, +) matrix over the automaton's states; those
of the first and last conversation of each partition, two at most, meet on the driver,
which tells each stretch the costs that follow it and then the state it is entered in.

Defined results: a role is trimmed and lower-cased; a null or unknown role fits any legal
role at UNKNOWN cost; a null or empty text renders as ''; a null turn comes last; turns
with equal numbers are ordered by role, then text; repeated rows stay; a null conversation
is one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import reliable
from .session import prepare

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("start", "system", "user", "assistant")
MERGE, INSERT, UNKNOWN, RELABEL = 1, 2, 2, 3
INFINITE = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: Empty messages that make role q legal after state s; absent: no way.
GAPS = {
    START: {SYSTEM: (), USER: (), ASSISTANT: (USER,)},
    SYSTEM: {USER: (), ASSISTANT: (USER,)},
    USER: {USER: (ASSISTANT,), ASSISTANT: ()},
    ASSISTANT: {USER: (), ASSISTANT: (USER,)},
}
#: Empty messages that end a conversation legally.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = tuple(INSERT * len(ENDINGS[s]) for s in range(4))


def role_class(role: str | None) -> int:
    """State of a known role, 0 for any other."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


@cache
def moves(state: int, role: int) -> tuple[tuple[int, int, bool, tuple[int, ...]], ...]:
    """(cost, new state, merged?, inserted) for a turn, in order of preference."""
    off = lambda q: 0 if q == role else UNKNOWN if role == 0 else RELABEL
    found = [(INSERT * len(gap) + off(q), q, False, gap) for q, gap in GAPS[state].items()]
    if state != START:
        found.append((MERGE + off(state), state, True, ()))
    return tuple(sorted(found, key=lambda m: (len(m[3]), m[1] != role, m[2], m[1])))


@cache
def _before(role: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """(costs to go before a turn, given those after it, less their least; that least)."""
    costs = [min(c + after[q] for c, q, _, _ in moves(s, role)) for s in range(4)]
    least = min(costs)
    return tuple(c - least for c in costs), least


def choose(state: int, role: int, after: tuple[int, ...]) -> tuple[int, int, bool, tuple[int, ...]]:
    """The first cheapest move of a turn, given the costs to go after it."""
    return min(moves(state, role), key=lambda m: m[0] + after[m[1]])


def backward(roles: list[int], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go after each turn, up to a constant of each turn."""
    out = []
    for role in reversed(roles):
        out.append(after)
        after = _before(role, after)[0]
    return out[::-1]


def forward(roles: list[int], state: int, after: tuple[int, ...]) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """The chosen move of each turn."""
    out = []
    for role, rest in zip(roles, backward(roles, after)):
        out.append(choose(state, role, rest))
        state = out[-1][1]
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    """Cost from each state at the beginning to each at the end."""
    columns = []
    for q in range(4):
        after, total = tuple(0 if s == q else INFINITE for s in range(4)), 0
        for role in reversed(roles):
            after, least = _before(role, after)
            total += least
        columns.append([min(a + total, INFINITE) for a in after])
    return [list(row) for row in zip(*columns)]


def stretches(batches) -> Iterator[tuple[int, str | None, list]]:
    """(partition, conversation, rows) of each run of rows of one conversation."""
    name, rows, part = None, [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and row[1] != name:
                yield part, name, rows
                rows = []
            part, name = row[0], row[1]
            rows.append(row)
    if rows:
        yield part, name, rows


def _ends(kind: str, known=None):
    """The first and last stretch of a partition: matrices, or entered state -> left state and messages."""

    def run(batches):
        found, last = [], None
        for part, name, rows in stretches(batches):
            last = (part, name, rows)
            if not found:
                found.append(last)
        if last is not None and last is not found[0]:
            found.append(last)
        out = []
        for place, (part, name, rows) in enumerate(found):
            roles = [role_class(r[2]) for r in rows]
            if kind == "matrix":
                made = [x for row in matrix(roles) for x in row]
            else:
                after, _ = known.value[(part, name)]
                made = []
                for s in range(4):
                    path = forward(roles, s, after)
                    made += [path[-1][1], sum(len(m[3]) + (not m[2]) for m in path)]
            out.append((part, place, name, made))
        if out:
            types = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["part", "place", "conv", "made"])

    return run


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: its action, role and message, and its piece of the rendering.

    The pieces of a conversation in order of ``position`` are its rendering, so no
    conversation has to fit into a row.  cost and n_inserted are the turn's own (its
    conversation's ending included in the last turn's).
    """
    spark = prepare(turns.sparkSession)
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kind, turn_kind = base.schema["conv"].dataType, base.schema["turn"].dataType
    # equal rows are told apart by number only to spread them; any order of them is the same
    keyed = base.withColumn("tie", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("tie"), F.col("text").isNull(), F.col("row")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = reliable(placed.select(F.spark_partition_id().alias("part"), F.col("conv").cast("string").alias("conv"), "role", "text", F.col("turn").cast("string").alias("turn")))
    schema = "part int, place int, conv string, made array<long>"

    thin = placed.select("part", "conv", "role")
    found = sorted((r["part"], r["place"], r["conv"], r["made"]) for r in _keyed(thin.mapInArrow(_ends("matrix"), schema).collect()))
    follow, after, owner = {}, END_COST, object()
    for part, _, conv, flat in reversed(found):
        if conv != owner:
            after, owner = END_COST, conv
        follow[(part, conv[1])] = (after, after is END_COST)
        costs = [min(flat[4 * s + q] + after[q] for q in range(4)) for s in range(4)]
        after = tuple(c - min(costs) for c in costs)
    shared = spark.sparkContext.broadcast(follow)
    left = sorted((r["part"], r["place"], r["conv"], r["made"]) for r in _keyed(thin.mapInArrow(_ends("states", shared), schema).collect()))
    entered, state, messages, owner = {}, START, 0, object()
    for part, _, conv, flat in left:
        if conv != owner:
            state, messages, owner = START, 0, conv
        entered[(part, conv[1])] = (state, messages, *follow[(part, conv[1])])
        messages += flat[2 * state + 1]
        state = flat[2 * state]
    begin = spark.sparkContext.broadcast(entered)

    def run(batches):
        for part, name, rows in stretches(batches):
            state, number, after, ends = begin.value.get((part, name), (START, 0, END_COST, True))
            first = number == 0 and state == START
            out = []
            path = forward([role_class(r[2]) for r in rows], state, after)
            for i, (row, (cost, to, merged, gap)) in enumerate(zip(rows, path)):
                inserted, text = len(gap), row[3] or ""
                if merged:
                    piece = "\n" + text
                else:
                    number += len(gap) + 1
                    piece = ("" if first else "\n" + CLOSE) + "".join(OPEN.format(ROLES[g]) + "\n" + CLOSE for g in gap) + OPEN.format(ROLES[to]) + text
                first = False
                action = ("merge" if merged else "keep") if ROLES[to] == ROLES[role_class(row[2])] else "merge_relabel" if merged else "relabel"
                message = number
                if ends and i == len(rows) - 1:
                    piece += "\n" + CLOSE + "".join(OPEN.format(ROLES[g]) + "\n" + CLOSE for g in ENDINGS[to])
                    inserted, cost = inserted + len(ENDINGS[to]), cost + END_COST[to]
                out.append((name, row[4], row[2], action, ROLES[to], message, inserted, cost, part, i, piece))
                if len(out) == 1024:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    made = placed.select("part", "conv", "role", "text", "turn").mapInArrow(run, _OUT)
    position = F.shiftleft(F.col("part").cast("long"), 40) + F.col("place")
    return made.select(F.col("conv").cast(kind).alias("conv_id"), F.col("turn").cast(turn_kind).alias("turn"), position.alias("position"), "role", "action", "new_role", "message", "n_inserted", "cost", "piece")


_OUT = "conv string, turn string, role string, action string, new_role string, message long, n_inserted int, cost int, part int, place long, piece string"
_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)


def _keyed(rows: list) -> list[dict]:
    """Conversations as sortable pairs: null first, as the range partitioning has it."""
    return [r.asDict() | {"conv": (r["conv"] is not None, r["conv"])} for r in rows]
