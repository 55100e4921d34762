"""Medians against sorted lists, narrowed or not; sketches against exact counts."""

import math
import random
import statistics
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waymark.operators import relational as R
from waymark.operators.selection import medians


def _rows(seed):
    r, rows = random.Random(seed), []
    makers = [lambda: r.random(), lambda: float(r.randrange(5)), lambda: 10 ** r.uniform(-300, 300), lambda: r.choice([-1, 1]) * 1e308 * r.random(), lambda: 7.0, lambda: r.choice([float("inf"), float("-inf"), 1.0, float("nan")])]
    for g, make in enumerate(makers):
        rows += [(f"g{g}" if g else None, None if r.random() < 0.1 else make()) for _ in range(r.choice([1, 2, 50, 101]))]
    return rows + [("none", None), ("none", None), ("two", 1.0), ("two", 2.0)]


@pytest.mark.parametrize("seed,most", [(0, 1 << 18), (1, 2), (2, 7)])
def test_medians(spark, seed, most):
    rows, groups = _rows(seed), defaultdict(list)
    for g, v in rows:
        groups[g] += [] if v is None else [v]
    df = spark.createDataFrame(rows, "v string, r1 double").repartition(3)  # named like inner columns
    found = {x["v"]: x["median"] for x in medians(df, ["v"], "r1", most=most).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        ordered = sorted(values, key=lambda x: (math.isnan(x), x if x == x else 0))
        want = None if not values else ordered[len(values) // 2] if len(values) % 2 else ordered[len(values) // 2] / 2 + ordered[len(values) // 2 - 1] / 2
        assert found[g] == want or (want is not None and math.isnan(want) and math.isnan(found[g])) or found[g] == pytest.approx(want, rel=1e-12), (g, values)
    assert medians(df.limit(0), ["v"], "r1").count() == 0


def test_a_wide_group_is_narrowed(spark):
    """A hundred thousand values, at most a hundred of them sorted in one place."""
    df = spark.range(100_001).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 100_003).cast("double").alias("x"))
    values = sorted((i * 7919) % 100_003 for i in range(100_001))
    assert medians(df, ["g"], "x", most=100).first()["median"] == statistics.median(values)


def test_no_median_of_a_whole_group():
    assert not [p for p in (Path(R.__file__).parent).glob("*.py") if "F.median(" in p.read_text() or "percentile(" in p.read_text()]


def test_sketches_unite(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("split"), (F.col("id") % 9000).alias("x")).unionByName(spark.createDataFrame([(1, None)], "split long, x long"))
    parts = R.distinct_sketches(df, ["split"], "x")
    whole = R.estimated_distinct(R.united_sketches(parts, [])).first()["n_distinct"]
    assert whole == R.estimated_distinct(R.distinct_sketches(df, [], "x")).first()["n_distinct"] and abs(whole / 9000 - 1) < 0.03
    exact = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count_distinct("x").alias("n")).collect()}
    assert all(abs(r["n_distinct"] / exact[r["split"]] - 1) < 0.03 for r in R.estimated_distinct(parts).collect())


def test_chains_of_experiments(spark):
    from waymark.sources.readers import training_chains

    rows = [("c", "b", "dpo"), ("b", "a", "sft"), ("a", "base", None), ("d", None, "x"), (None, "a", "y"), ("e", "missing", "z")]
    found = {r["name"]: (r["origin"], r["chain"]) for r in training_chains(spark.createDataFrame(rows, "name string, base string, task string")).collect()}
    assert found == {"c": ("base", [None, "sft", "dpo"]), "b": ("base", [None, "sft"]), "a": ("base", [None]), "d": (None, ["x"]), "e": ("missing", ["z"])}
    with pytest.raises(Exception, match="(?i)recursi"):
        training_chains(spark.createDataFrame([("a", "b", "x"), ("b", "a", "y")], "name string, base string, task string")).collect()


def test_chains_of_any_depth_and_number(spark):
    """Deeper than a recursion goes, and more steps in all than the million that it may return."""
    from waymark.sources.readers import training_chains

    n, e = 130, F.col("id")
    rows = spark.range(0, n * 130, 1, 2).select(e.cast("string").alias("name"), F.when(e % n > 0, (e - 1).cast("string")).otherwise("origin").alias("base"), (e % n).cast("string").alias("task"))
    found = training_chains(rows).select("name", "origin", F.size("chain").alias("n"), (F.array_join("chain", ",") == F.array_join(F.transform(F.sequence(F.lit(0), F.size("chain") - 1), lambda x: x.cast("string")), ",")).alias("same")).collect()
    assert len(found) == n * 130 and all(r["n"] == int(r["name"]) % n + 1 and r["same"] and r["origin"] == "origin" for r in found)


def test_a_circle_raises_before_its_chain_grows(spark, monkeypatch):
    from waymark.sources import readers

    monkeypatch.setattr(readers, "CHECKED", 1)
    rows = [(str(i), str((i + 1) % 7), "x") for i in range(7)] + [("in", "3", "x")]
    with pytest.raises(ValueError, match="circle"):
        readers.training_chains(spark.createDataFrame(rows, "name string, base string, task string").coalesce(1))


def test_changes_of_diffs_as_rows(spark):
    from waymark.functions import code as C

    rows = [(1, None), (2, ""), (3, "@@ -3,2 +3 @@\n-- a comment\n b\nc\n\\ No newline\n@@ -9 +9 @@\n@@ -1 +1 @@\r\n+x -y")]
    found = sorted((r["id"], r["hunk"], r["old_start"], -1 if r["place"] is None else r["place"], r["op"], r["line"]) for r in C.with_diff_changes(spark.createDataFrame(rows, "id int, d string"), "d").collect())
    assert found == [(3, 0, 3, 0, "-", "- a comment"), (3, 0, 3, 1, " ", "b"), (3, 0, 3, 2, " ", "c"), (3, 1, 9, -1, None, None), (3, 2, 1, 0, "+", "x"), (3, 2, 1, 1, "-", "y")]
    assert [len(h["changes"]) for h in C.parse_diff(rows[2][1])] == [3, 0, 2]


def test_folders_are_left_out_whatever_their_case(spark, tmp_path):
    from waymark.sources.readers import discover

    for name in ("a/One_Step/x", "b/one", "c/oNE_sTEP.parquet"):
        spark.createDataFrame([(name,)], "n string").coalesce(1).write.parquet(str(tmp_path / name))
    assert {r["n"] for r in discover(spark, str(tmp_path), excluding="ONE_step").collect()} == {"b/one"}


def test_six_metrics_are_shown(spark):
    from waymark.operators import reports

    rows = [(m, x, k, 0.5 + k / 10 * s, 0.4, 0.3) for m, x, s in (("m", "A", 1), ("m", "B", -1), ("n", "A", 0)) for k in (1, 2, 3)]
    table = reports.six_metrics(spark.createDataFrame(rows, "model string, method string, k int, coverage double, grade_proximity double, codebleu double"), ["model", "method"])
    found = {(r["model"], r["method"]): r for r in table.collect()}
    assert found["m", "A"]["delta_coverage"] == 0.15 and found["m", "A"]["best_delta_coverage"] and not found["m", "B"]["best_delta_coverage"]
    lines = reports.latex_rows(table, "model", "method", [*reports.METRICS, *(f"delta_{m}" for m in reports.METRICS)]).splitlines()
    assert lines[0] == "m & A & \\textbf{0.700} & \\textbf{0.400} & \\textbf{0.300} & \\textbf{0.150} & \\textbf{0.000} & \\textbf{0.000} \\\\" and len(lines) == 3
    low = reports.best_per_group(table, ["model"], ["coverage"], lower=["coverage"]).where("model = 'm' and best_coverage").collect()
    assert [r["method"] for r in low] == ["B"]
