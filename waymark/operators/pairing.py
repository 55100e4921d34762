"""Pairs of a step and a later one, drawn within trajectories in n log² n.

A trajectory's steps come to one task in order, but no step meets another: counts of free steps lie
in Fenwick trees, one over all steps and one for each class, so "the r-th free step from here on
that is of another class" is a search in two of them.  A trajectory is held in memory
(some hundred bytes a step), never its pairs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship


class Counts:
    """A Fenwick tree over n places that are all counted at first."""

    def __init__(self, n: int) -> None:
        self.tree = [i & -i for i in range(n + 1)]

    def before(self, place: int) -> int:
        """How many of the places 0..place-1 still count."""
        total = 0
        while place > 0:
            total += self.tree[place]
            place &= place - 1
        return total

    def drop(self, place: int) -> None:
        place += 1
        while place < len(self.tree):
            self.tree[place] -= 1
            place += place & -place


class Free:
    """The free steps of a trajectory, by place and class; a step without a class never counts."""

    def __init__(self, classes: Sequence) -> None:
        self.all = Counts(len(classes))
        self.places: dict = {}
        for i, c in enumerate(classes):
            if c is None:
                self.all.drop(i)
            else:
                self.places.setdefault(c, []).append(i)
        self.of = {c: Counts(len(places)) for c, places in self.places.items()}

    def _other(self, cls, place: int) -> int:
        """Free steps of other classes before a place."""
        return self.all.before(place) - (self.of[cls].before(bisect_left(self.places[cls], place)) if cls in self.of else 0)

    def count(self, cls, start: int) -> int:
        """Free steps from a place on that aren't of a class."""
        n = len(self.all.tree) - 1
        return self._other(cls, n) - self._other(cls, min(start, n))

    def find(self, cls, start: int, rank: int) -> int:
        """The place of the step of that rank, from 0, among those that ``count`` counts."""
        goal, place, total, n = self._other(cls, start) + rank, 0, 0, len(self.all.tree) - 1
        own, places = self.of.get(cls), self.places.get(cls, [])
        step = 1 << n.bit_length() - 1
        while step:  # the greatest place before which at most ``goal`` others are free
            at = place + step
            if at <= n:
                reached = total + self.all.tree[at]
                if reached - (own.before(bisect_right(places, at - 1)) if own else 0) <= goal:
                    place, total = at, reached
            step >>= 1
        return place

    def take(self, cls, place: int) -> None:
        self.all.drop(place)
        self.of[cls].drop(bisect_left(self.places[cls], place))


def _pairs(seqs: list, classes: list, hashes: list, numbers: list, turns: list, distance: int, replace: bool) -> Iterator[tuple[int, int]]:
    """(place, place) of one trajectory; ``numbers`` draw the rank, ``turns`` order the anchors."""
    free, n = Free(classes), len(seqs)
    for i in sorted(range(n), key=lambda k: (turns[k], k)):
        start = bisect_left(seqs, seqs[i] + distance) if distance > 1 else i + 1
        if classes[i] is None or not (left := free.count(classes[i], start)):
            continue
        j = free.find(classes[i], start, numbers[i] % left)
        if hashes[i] == hashes[j]:
            continue
        if not replace:
            free.take(classes[j], j)
        yield i, j


def _trajectories(batches, keys: int) -> Iterator[pa.Table]:
    """The rows of one trajectory after another, of batches sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b] if held else [b]).combine_chunks()
        ahead, n = len(held) > 0, rows.num_rows - 1
        new = pa.array([False] * n, pa.bool_())
        for c in rows.columns[:keys]:
            a, z = c.slice(0, n), c.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
            new = pc.or_(new, pc.invert(same))
        last = 0
        for at in pc.indices_nonzero(new).to_pylist():
            at += not ahead  # where a new trajectory begins in b
            if at > last:
                held.append(b.slice(last, at - last))
            yield pa.Table.from_batches(held)
            held, last = [], at
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def drawn_pairs(steps: DataFrame, keys: Sequence[str], kind: str = "temporal", grade: str = "grade", code_hash: str = "code_hash", distance: int = 3, replace: bool = False, drawn: bool = True, seed: str = "") -> DataFrame:
    """(keys, seq, rejected_seq): a later step for each, drawn at random or the first there is.

    'temporal' draws among the steps at least ``distance`` later with another hash; 'grade' among
    all later ones of another known grade, and gives the anchor up if the hashes agree.  Without
    ``replace`` a step is rejected at most once.  With ``drawn`` anchors take their turns in an
    order of hashes and each draws a rank from its own hash; otherwise they go in order of seq and take
    the first.  Seqs of a trajectory ascend without repeats; a null key is a key like others.
    """
    if kind not in ("temporal", "grade"):
        raise ValueError(f"unknown kind {kind!r}")
    ship(steps.sparkSession)
    names = [*(F.col(k).cast("string") for k in keys), F.col("seq").cast("string")]
    digest = lambda what: F.md5(F.concat_ws("|", F.lit(what), F.lit(seed), *names).cast("binary"))
    number = F.conv(F.substring(digest("draw"), 1, 8), 16, 10).cast("long")
    cls = F.col(code_hash).cast("string") if kind == "temporal" else F.nanvl(F.col(grade).cast("double"), F.lit(None).cast("double"))
    slim = steps.select(*keys, F.col("seq").cast("int").alias("seq"), cls.alias("_waymark_class"), F.col(code_hash).cast("string").alias("_waymark_hash"), (number if drawn else F.lit(0).cast("long")).alias("_waymark_draw"), (digest("turn") if drawn else F.lit("")).alias("_waymark_turn"))
    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    least = distance if kind == "temporal" else 1

    def run(batches):
        for rows in _trajectories(batches, len(keys)):
            seqs, *columns = (rows[c].to_pylist() for c in ("seq", "_waymark_class", "_waymark_hash", "_waymark_draw", "_waymark_turn"))
            if kind == "temporal":  # another hash is what the class says
                columns[1] = list(range(len(seqs)))
            found = list(_pairs(seqs, *columns, least, replace))
            if found:
                own = [rows[k].slice(0, 1).combine_chunks().take(pa.array([0] * len(found))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([seqs[i] for i, _ in found], pa.int32()), pa.array([seqs[j] for _, j in found], pa.int32())], [*keys, "seq", "rejected_seq"])

    placed = slim.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return placed.mapInArrow(run, ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", seq int, rejected_seq int")
