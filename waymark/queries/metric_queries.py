"""Rollout metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import metrics as M
from ..functions import text as X
from ..operators import reports as R
from .fixtures import DETAILED, ROLLOUT, detailed, rollout_rows, table
from .registry import query

_BY_K = f"""{DETAILED}, by_k AS (SELECT model, method, k, count(*)::BIGINT AS n_rows, round_even(round(sum(has_valid_pair)::DOUBLE / sum(has_ground_truth), 9), 3) AS coverage, round_even(round(avg(grade_proximity), 9), 3) AS grade_proximity, round_even(round(avg(codebleu), 9), 3) AS codebleu FROM detailed GROUP BY ALL)"""
_ALL = ("coverage", "grade_proximity", "codebleu")


def _by_k(spark, sf_dir):
    return R.coverage_by(detailed(spark, sf_dir), ["model", "method", "k"], ["grade_proximity", "codebleu"])


@query(f"WITH {DETAILED} SELECT student_id, problem_id, starting_position::INTEGER AS starting_position, k::INTEGER AS k, has_ground_truth::INTEGER AS has_ground_truth, has_model_code::INTEGER AS has_model_code, has_valid_pair::INTEGER AS has_valid_pair, round(grade_difference, 6) AS grade_difference, round(grade_proximity, 6) AS grade_proximity, codebleu FROM detailed")
def kstep_metrics(spark, sf_dir):
    rows = detailed(spark, sf_dir)
    return rows.select("student_id", "problem_id", "starting_position", "k", "has_ground_truth", "has_model_code", "has_valid_pair", F.round("grade_difference", 6).alias("grade_difference"), F.round("grade_proximity", 6).alias("grade_proximity"), "codebleu")


@query(f"WITH {DETAILED} SELECT k::INTEGER AS k, count(*)::BIGINT AS n_rows, round_even(round(sum(has_valid_pair)::DOUBLE / sum(has_ground_truth), 9), 3) AS coverage, round_even(round(avg(grade_proximity), 9), 3) AS grade_proximity FROM detailed GROUP BY k")
def coverage_by_k(spark, sf_dir):
    return R.coverage_by(detailed(spark, sf_dir), ["k"])


@query(f"WITH {_BY_K} SELECT model, method, k::INTEGER AS k, n_rows, coverage, grade_proximity, codebleu FROM by_k")
def coverage_by_method_k(spark, sf_dir):
    return _by_k(spark, sf_dir)


@query(f"WITH {_BY_K} SELECT model, method, round_even(round(avg(coverage), 9), 3) AS coverage, round_even(round(avg(grade_proximity), 9), 3) AS grade_proximity, round_even(round(avg(codebleu), 9), 3) AS codebleu FROM by_k GROUP BY ALL")
def macro_table(spark, sf_dir):
    return R.macro(_by_k(spark, sf_dir), ["model", "method"], _ALL)


@query(f"WITH {DETAILED} SELECT model, method, count(*)::BIGINT AS n_rows, round_even(round(avg(grade_proximity), 9), 3) AS grade_proximity, round_even(round(avg(codebleu), 9), 3) AS codebleu FROM detailed GROUP BY ALL")
def micro_table(spark, sf_dir):
    return R.micro(detailed(spark, sf_dir), ["model", "method"], ["grade_proximity", "codebleu"])


_DELTA = "d AS (SELECT b.model, b.method, {} FROM by_k b JOIN by_k o ON o.model = b.model AND o.method = b.method AND o.k = 1 WHERE b.k BETWEEN 2 AND 5 GROUP BY ALL)".format(", ".join(f"avg(b.{m} - o.{m}) AS delta_{m}" for m in _ALL))


@query(f"WITH {_BY_K}, {_DELTA} SELECT model, method, {', '.join(f'round(delta_{m}, 6) AS delta_{m}' for m in _ALL)} FROM d")
def degradation(spark, sf_dir):
    out = R.degradation(_by_k(spark, sf_dir), ["model", "method"], _ALL)
    return out.select("model", "method", *(F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in _ALL))


@query(f"WITH {_BY_K}, {_DELTA}, m AS (SELECT model, method, {', '.join(f'round_even(round(avg({m}), 9), 3) AS {m}' for m in _ALL)} FROM by_k GROUP BY ALL) SELECT model, method, {', '.join(_ALL)}, {', '.join(f'round(delta_{m}, 6) AS delta_{m}' for m in _ALL)} FROM m LEFT JOIN d USING (model, method)")
def averaged_table(spark, sf_dir):
    out = R.averaged_with_degradation(_by_k(spark, sf_dir), ["model", "method"], _ALL)
    return out.select("model", "method", *_ALL, *(F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in _ALL))


@query(f"WITH {DETAILED} SELECT model, method, " + ", ".join(f"round_even(round(avg({m}){f}, 9), 3) AS {m}_{n}" for m in ("grade_proximity", "codebleu") for n, f in (("all", ""), ("solved", " FILTER (trajectory_solved)"), ("unsolved", " FILTER (NOT trajectory_solved)"))) + " FROM detailed GROUP BY ALL")
def stratified(spark, sf_dir):
    return R.stratified(detailed(spark, sf_dir), ["model", "method"], ["grade_proximity", "codebleu"])


@query(f"WITH {_BY_K} SELECT model, method, k::INTEGER AS k, coverage, abs(coverage - max(coverage) OVER (PARTITION BY model)) < 1e-6 AS best_coverage FROM by_k")
def best_per_group(spark, sf_dir):
    return R.best_per_group(_by_k(spark, sf_dir), ["model"], ["coverage"]).select("model", "method", "k", "coverage", "best_coverage")


_SIX = (*_ALL, *(f"delta_{m}" for m in _ALL))


@query(f"WITH {_BY_K}, {_DELTA}, m AS (SELECT model, method, {', '.join(f'round_even(round(avg({m}), 9), 3) AS {m}' for m in _ALL)} FROM by_k GROUP BY ALL), t AS (SELECT model, method, {', '.join(_ALL)}, {', '.join(f'round_even(round(delta_{m}, 9), 3) AS delta_{m}' for m in _ALL)} FROM m LEFT JOIN d USING (model, method)) SELECT *, {', '.join(f'abs({m} - max({m}) OVER (PARTITION BY model)) < 1e-6 AS best_{m}' for m in _SIX)} FROM t")
def six_metric_table(spark, sf_dir):
    """Means and degradations of three metrics, with the best of each model marked."""
    return R.six_metrics(_by_k(spark, sf_dir), ["model", "method"])


@query(f"WITH {DETAILED} SELECT model, CASE student_id % 2 WHEN 0 THEN 'dual' ELSE 'code' END AS format, ['base', 'lora', 'full'][student_id % 3 + 1] AS training, method, k::INTEGER AS k, count(*)::BIGINT AS n_rows, round_even(round(sum(has_valid_pair)::DOUBLE / sum(has_ground_truth), 9), 3) AS coverage, round_even(round(avg(grade_proximity), 9), 3) AS grade_proximity FROM detailed GROUP BY ALL")
def coverage_by_training(spark, sf_dir):
    """Aggregates by model, format of submissions, kind of training, method and k."""
    rows = detailed(spark, sf_dir).withColumn("format", F.when(F.col("student_id") % 2 == 0, "dual").otherwise("code"))
    rows = rows.withColumn("training", F.element_at(F.array(*map(F.lit, ("base", "lora", "full"))), (F.col("student_id") % 3 + 1).cast("int")))
    return R.coverage_by(rows, ["model", "format", "training", "method", "k"])


@query(f"""WITH {ROLLOUT}, p AS (SELECT *, round_even((k + step - 1)::DOUBLE / greatest(max(k + step - 1) OVER (PARTITION BY user_id, problem_id), 1) * 10, 0) / 10 AS position, CASE WHEN code NOT IN ('', 'exit()') THEN grade END AS pred FROM rollouts),
lines AS (SELECT model, 'student' AS line, position, student_grade / 100 AS g FROM p WHERE model <> 'm1' UNION ALL SELECT model, method, position, pred / 100 FROM p WHERE model <> 'm1' UNION ALL SELECT m.model, 'm1', position, pred / 100 FROM p JOIN (SELECT DISTINCT model FROM p WHERE model <> 'm1') m ON true WHERE p.model = 'm1')
SELECT model, line, position, count(g)::BIGINT AS n, round(avg(g), 9) AS mean, round(stddev_samp(g) / sqrt(count(g)), 9) AS se FROM lines WHERE g IS NOT NULL GROUP BY ALL""")
def grade_progression(spark, sf_dir):
    """Grades along the trajectory: students, methods and the reference model m1 in one frame."""
    rows = rollout_rows(spark, sf_dir).withColumnsRenamed({"k": "starting_position", "step": "k"})
    answered = ~X.is_recording(F.col("code"))
    rows = R.with_position(rows.withColumn("pred_grade", F.when(answered, F.col("grade"))), ["user_id", "problem_id"])
    out = R.grade_lines(rows, "model", "method", "m1", true="student_grade")
    return out.select("model", "line", "position", "n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


#: BLEU of two loops over range(N) that differ in N alone, and its form that weighs keywords: 14 tokens, N the sixth.
_LOOP = "exp((ln({} / {}) + ln(12.0::DOUBLE / 14) + ln(10.0::DOUBLE / 13) + ln(8.0::DOUBLE / 12)) / 4)"
_NGRAM, _WEIGHTED = _LOOP.format("13.0::DOUBLE", 14), _LOOP.format("4.2::DOUBLE", 4.4)


@query(f"""WITH {ROLLOUT}, s AS (SELECT method, step, code = student_code AS same FROM rollouts WHERE code NOT IN ('', 'exit()') AND student_code <> '')
SELECT method, step::INTEGER AS k, count(*)::BIGINT AS n, round(avg(CASE WHEN same THEN 1 ELSE {_NGRAM} END), 9) AS ngram, round(avg(CASE WHEN same THEN 1 ELSE {_WEIGHTED} END), 9) AS weighted, 1.0::DOUBLE AS tree, 1.0::DOUBLE AS flow,
  round(avg(CASE WHEN same THEN 1 ELSE ({_NGRAM} + {_WEIGHTED} + 2) / 4 END), 9) AS codebleu FROM s GROUP BY ALL""")
def kstep_codebleu(spark, sf_dir):
    """CodeBLEU and its parts of the programs of rollouts, by method and k.  Each distinct pair of
    programs is compared once."""
    program = lambda c: F.concat(F.lit("for i in range("), F.col(c), F.lit("):\n    print(i)\n"))
    rows = R.k_step_metrics(rollout_rows(spark, sf_dir)).where("has_valid_pair = 1").select("method", F.col("step").alias("k"), program("student_code").alias("true"), program("code").alias("made"))
    counts = rows.groupBy("method", "k", "true", "made").agg(F.count("*").alias("c"))
    pairs = counts.select("true", "made").distinct().withColumn("p", C.udf("codebleu_parts")("true", "made"))
    parts = counts.join(pairs, ["true", "made"]).select("method", "k", "c", "p.*").withColumn("codebleu", (F.col("ngram") + F.col("weighted") + F.col("tree") + F.col("flow")) / 4)
    mean = lambda m: F.round(F.sum(F.col(m) * F.col("c")) / F.sum("c"), 9).alias(m)
    return parts.groupBy("method", "k").agg(F.sum("c").alias("n"), *map(mean, ("ngram", "weighted", "tree", "flow", "codebleu")))


_POS = f"""{DETAILED}, placed AS (SELECT *, starting_position + k - 1 AS absolute_position, (starting_position + k - 1)::DOUBLE / greatest(max(starting_position + k - 1) OVER (PARTITION BY student_id, problem_id), 1) AS share FROM detailed)"""


@query(f"WITH {_POS} SELECT student_id, problem_id, starting_position::INTEGER AS starting_position, k::INTEGER AS k, absolute_position::INTEGER AS absolute_position, round(share, 6) AS normalized_position, round_even(share * 10, 0) / 10 AS position FROM placed")
def positions(spark, sf_dir):
    out = R.with_position(detailed(spark, sf_dir))
    return out.select("student_id", "problem_id", "starting_position", "k", "absolute_position", F.round("normalized_position", 6).alias("normalized_position"), "position")


@query(f"WITH {_POS}, g AS (SELECT method, round_even(share * 10, 0) / 10 AS position, grade_proximity AS x FROM placed WHERE grade_proximity IS NOT NULL) SELECT method, position, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, count(*)::BIGINT AS n, round(stddev_samp(x) / sqrt(count(*)), 9) AS se, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 9) AS low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 9) AS high FROM g GROUP BY ALL")
def progression_bins(spark, sf_dir):
    out = R.progression(R.with_position(detailed(spark, sf_dir)), ["method", "position"], "grade_proximity")
    return out.select("method", "position", "n", *(F.round(c, 9).alias(c) for c in ("mean", "std", "se", "low", "high")))


@query(f"WITH {_POS} SELECT method, round_even(share * 10, 0) / 10 AS position, round(least(sum(has_model_code)::DOUBLE / greatest(sum(has_ground_truth), 1), 1), 6) AS coverage FROM placed GROUP BY ALL")
def plotted_coverage(spark, sf_dir):
    out = R.plotted_coverage(R.with_position(detailed(spark, sf_dir)), ["method", "position"])
    return out.select("method", "position", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_BY_K} SELECT model, method, k::INTEGER AS k, metric, value FROM (UNPIVOT by_k ON coverage, grade_proximity INTO NAME metric VALUE value)")
def unpivot_metrics(spark, sf_dir):
    return R.melted(_by_k(spark, sf_dir), ["model", "method", "k"], ["coverage", "grade_proximity"])


@query(f"WITH {DETAILED} SELECT k::INTEGER AS k, round(avg(grade_proximity), 6) AS grade_proximity FROM detailed WHERE model = 'm1' GROUP BY k")
def reference_line(spark, sf_dir):
    return R.reference_line(detailed(spark, sf_dir), "model", "m1", "grade_proximity").select("k", F.round("grade_proximity", 6).alias("grade_proximity"))


@query(f"WITH {DETAILED} SELECT model, count(*)::BIGINT AS n_rows, count(DISTINCT student_id)::BIGINT AS n_students, count(DISTINCT problem_id)::BIGINT AS n_problems, round(sum(has_valid_pair)::DOUBLE / sum(has_ground_truth), 6) AS coverage FROM detailed GROUP BY model")
def experiment_summary(spark, sf_dir):
    return R.experiment_summary(detailed(spark, sf_dir), ["model"]).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {ROLLOUT} SELECT sum((code IN ('', 'exit()'))::INT)::BIGINT AS recording, count(*)::BIGINT AS n_rows FROM rollouts")
def recording_share(spark, sf_dir):
    return R.recording_share(rollout_rows(spark, sf_dir))


@query(f"WITH {ROLLOUT} SELECT count(DISTINCT (user_id, problem_id, k))::BIGINT AS n_tasks, avg(CASE WHEN step = 1 THEN (code = 'exit()')::INT END) AS exit_rate FROM rollouts")
def rollout_summary(spark, sf_dir):
    return rollout_rows(spark, sf_dir).agg(F.count_distinct("user_id", "problem_id", "k").alias("n_tasks"), F.avg(F.when(F.col("step") == 1, (F.col("code") == "exit()").cast("int"))).alias("exit_rate"))


_FLAGS = "l_quantity > 5 AS fence, l_quantity > 10 AS good, l_quantity > 15 AS ran, l_quantity > 45 AS same, l_linenumber * 20.0 AS grade, 60.0 AS target, l_extendedprice / 100 AS len"
_PEN = "CASE WHEN len <= 855 - 0 THEN CASE WHEN len <= {a} THEN 0.0 WHEN len <= {b} THEN ({a} - len) / {c}::DOUBLE ELSE -1.0 END ELSE CASE WHEN len <= {b} THEN ({a} - len) / {c}::DOUBLE ELSE -1.0 END END".format(a=855, b=950, c=95)


@query(f"WITH f AS (SELECT l_orderkey, l_linenumber, {_FLAGS} FROM lineitem), p AS (SELECT *, {_PEN} AS pen FROM f) SELECT l_orderkey, l_linenumber, round(greatest(CASE WHEN NOT fence THEN -1.0 WHEN NOT good THEN -0.5 WHEN NOT ran THEN 0.0 WHEN same THEN 2.0 WHEN abs(grade - target) < 1e-6 THEN 1.0 ELSE 0.0 END + 0.5 * pen, -0.75), 6)::DOUBLE AS reward FROM p")
def reward(spark, sf_dir):
    q = F.col("l_quantity")
    r = M.reward(q > 5, q > 10, q > 15, q > 45, F.col("l_linenumber") * 20.0, F.lit(60.0), M.length_penalty(F.col("l_extendedprice") / 100, 1000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(r, 6).alias("reward"))


@query(f"WITH f AS (SELECT o_orderkey, o_totalprice / 300 AS len FROM orders) SELECT o_orderkey, round({_PEN}, 6)::DOUBLE AS penalty FROM f")
def overlong_penalty(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(M.length_penalty(F.col("o_totalprice") / 300, 1000), 6).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 6) END AS ratio, round_even(least(greatest(l_discount * 12, 0), 1) * 10, 0) / 10 AS tenth, round_even(l_quantity / 4, 0) AS whole FROM lineitem")
def ratios_and_bins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"), M.decile(M.clip(F.col("l_discount") * 12)).alias("tenth"), M.whole_grade(F.col("l_quantity") / 4).alias("whole"))
