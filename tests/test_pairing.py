"""Drawn pairs and truncated contexts against plain loops over all pairs; growth."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from waymark.operators import pairing
from waymark.operators import sequence as W
from waymark.plans import datasets as D

KEYS = ["user", "task"]


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_ranks(seed):
    r = random.Random(seed)
    classes = [r.choice(["a", "b", "c", None]) for _ in range(r.choice([1, 7, 64, 100]))]
    free, left = pairing.Free(classes), {i for i, c in enumerate(classes) if c is not None}
    for _ in range(150):
        start, cls = r.randrange(len(classes) + 1), r.choice(["a", "b", "c", "unknown"])
        want = [i for i in sorted(left) if i >= start and classes[i] != cls]
        assert free.count(cls, start) == len(want)
        assert [free.find(cls, start, k) for k in range(len(want))] == want
        if left:
            i = r.choice(sorted(left))
            left.remove(i)
            free.take(classes[i], i)


def _plain(rows, kind, distance, replace, drawn, seed):
    """Pairs of one trajectory, every anchor looking at every later step."""
    number = lambda what, row: hashlib.md5("|".join([what, seed, *(x for x in row[:2] if x is not None), str(row[2])]).encode()).hexdigest()
    used, out = set(), []
    for row in sorted(rows, key=lambda x: (number("turn", x), x[2]) if drawn else x[2]):
        cls = 3 if kind == "temporal" else 4
        far = row[2] + (distance if kind == "temporal" else 1)
        free = [x for x in sorted(rows, key=lambda x: x[2]) if x[2] >= far and x[2] not in used and x[cls] is not None and row[cls] is not None and x[cls] == x[cls] and row[cls] == row[cls] and x[cls] != row[cls]]
        if free:
            pick = free[int(number("draw", row)[:8], 16) % len(free) if drawn else 0]
            if pick[3] != row[3]:
                out.append((row[0], row[1], row[2], pick[2]))
                if not replace:
                    used.add(pick[2])
    return out


@pytest.mark.parametrize("kind", ["temporal", "grade"])
@pytest.mark.parametrize("replace,drawn", [(False, True), (True, True), (False, False)])
def test_pairs_by_all_pairs(spark, kind, replace, drawn):
    r, rows = random.Random(5), []
    for u in range(25):
        seqs = sorted(r.sample(range(1, 60), r.randrange(1, 30)))
        rows += [(f"u{u}" if u else None, r.choice("t") if u % 3 else None, s, r.choice(["a", "b", "c", "d", None]), r.choice([1.0, 2.0, None, float("nan")])) for s in seqs]
    df = spark.createDataFrame(rows, "user string, task string, seq int, code_hash string, grade double").repartition(5)
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = [tuple(x) for x in pairing.drawn_pairs(df, KEYS, kind, distance=3, replace=replace, drawn=drawn, seed="z").collect()]
        want = [p for k in {x[:2] for x in rows} for p in _plain([x for x in rows if x[:2] == k], kind, 3, replace, drawn, "z")]
        assert sorted(map(str, found)) == sorted(map(str, want)) and found
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairing.drawn_pairs(df.limit(0), KEYS, kind).count() == 0
    with pytest.raises(ValueError):
        pairing.drawn_pairs(df, KEYS, "other")


def test_a_long_trajectory_is_no_square():
    r = random.Random(1)
    n = 10_000
    for classes in (list(range(n)), [r.choice("ab") for _ in range(n)]):
        began = time.process_time()
        found = list(pairing._pairs(list(range(1, n + 1)), classes, list(range(n)), [r.randrange(1 << 32) for _ in range(n)], [r.random() for _ in range(n)], 3, False))
        assert len({j for _, j in found}) == len(found) > n // 3
        assert time.process_time() - began < 2


def test_choices_are_spread(spark):
    """With replacement every later step is chosen about as often as others of its place."""
    s = spark.range(1, 401).select(F.lit("a").alias("user"), F.lit("t").alias("task"), F.col("id").cast("int").alias("seq"), F.col("id").cast("string").alias("code_hash"))
    gaps = [(x["rejected_seq"] - x["seq"]) / (400 - x["seq"]) for x in W.temporal_pairs(s, KEYS, distance=1).where("seq < 300").collect()]
    assert 0.4 < sum(gaps) / len(gaps) < 0.6 and len({round(g, 1) for g in gaps}) > 8


@pytest.mark.parametrize("seed", range(4))
def test_truncated_targets_equal_truncated_contexts(spark, seed):
    """Each target's context as ``truncate_left`` cuts it, turn orders of all kinds."""
    r, rows = random.Random(seed), []
    for c in range(60):
        for p in range(r.randrange(1, 14)):
            rows.append((c if c else None, p * r.choice([1, 1, 3]) + p * 3, r.choice(["user", "assistant", "assistant", "system"] if p else ["system", "system", "user", "assistant"]), r.choice([0, 1, 2, 5, 9])))
    df = spark.createDataFrame(rows, "c int, pos int, role string, tok int").dropDuplicates(["c", "pos"])
    for budget in (4, 12, 30, 1000):
        got = W.truncated_targets(df, ["c"], budget, F.col("tok"), F.col("role") == "assistant")
        targets = df.where("role = 'assistant'").select(F.col("c").alias("g"), F.col("pos").alias("target"))
        context = targets.join(df, F.col("g").eqNullSafe(F.col("c"))).where("pos <= target").drop("g")
        cut = W.truncate_left(context, ["c", "target"], budget, F.col("tok")).groupBy("c", "target").agg(F.max("kept_from").alias("kept_from"), F.count("*").alias("n_messages"), F.max("truncated").alias("truncated"))
        assert sorted(map(str, got.collect())) == sorted(map(str, cut.select(*got.columns).collect()))
    assert W.truncated_targets(df.limit(0), ["c"], 5, F.col("tok"), F.lit(True)).count() == 0


def test_counters_of_a_written_truncation(spark, tmp_path):
    rows = [(1, 0, "system", 2), (1, 1, "user", 3), (1, 2, "assistant", 9), (2, 0, "user", 1), (3, 0, "user", 50), (4, 0, "user", 1), (4, 1, "assistant", 99), (4, 2, "user", 1), (4, 3, "assistant", 3)]
    t = spark.createDataFrame(rows, "c int, pos int, role string, tok int")
    path, counts = D.write_truncated(t, ["c"], 8, F.col("tok"), str(tmp_path / "a"))
    assert counts == {"n": 4, "n_truncated": 2, "n_rejected": 1} and spark.read.parquet(path).count() == 5
    assert D.write_truncated(t.limit(0), ["c"], 8, F.col("tok"), str(tmp_path / "b"))[1] == {"n": 0, "n_truncated": 0, "n_rejected": 0}
