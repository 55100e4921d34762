"""Test tables in the shape of the data model, in Spark and as SQL.

events are submissions: user_id the person, event_type the task, the value's bucket of 25
the program, props.k the grade.  conversations are turns.  Rollout rows come from the grid
of tasks, with the program and grade of the submission after as prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import md5
from ..operators import reports, sequence

KEYS = ["user_id", "problem_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.floor(F.col("value") / 25).cast("long").cast("string")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("problem_id"), "ts", "event_id", "value", code.alias("code"), md5(code).alias("code_hash"), F.get_json_object("props", "$.k").cast("double").alias("grade"))
    return sequence.number_steps(rows, KEYS, ["ts", "event_id"])


STEPS = """steps AS (
  SELECT user_id, event_type AS problem_id, ts, event_id, value, floor(value / 25)::BIGINT::VARCHAR AS code, md5(floor(value / 25)::BIGINT::VARCHAR) AS code_hash,
    json_extract_string(props, '$.k')::DOUBLE AS grade, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS seq
  FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), "role", F.col("text").alias("content"))


TURNS = "turns AS (SELECT conv_id, turn::INTEGER AS pos, role, text AS content FROM conversations)"


def fenced(text):
    return F.concat(F.lit("Note\n```python\n"), text, F.lit("\n```\nend <think>a b</think>"))


FENCED = "'Note\n```python\n' || {} || '\n```\nend <think>a b</think>'"


def rollout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    lengths = s.groupBy(*KEYS).agg(F.max("seq").alias("n"))
    truth = s.select(*KEYS, "seq", F.col("code").alias("student_code"), F.col("grade").alias("student_grade"))
    after = s.select(*KEYS, (F.col("seq") - 1).alias("seq"), F.col("code").alias("made"), F.col("grade").alias("made_grade"))
    rows = sequence.align_truth(sequence.rollout_grid(lengths, "n"), truth, KEYS).join(after, [*KEYS, "seq"], "left")
    code = F.when((F.col("user_id") + F.col("k") + F.col("step")) % 6 == 0, "exit()").otherwise(F.coalesce("made", F.lit("")))
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    method = F.element_at(F.array(*map(F.lit, ("BASE", "SFT", "DPO", "GRPO", "PARA"))), (F.col("user_id") % 5 + 1).cast("int"))
    return rows.select(*KEYS, "k", "step", "seq", code.alias("code"), F.col("made_grade").alias("grade"), "student_code", "student_grade", model.alias("model"), method.alias("method"))


ROLLOUT = f"""{STEPS}, lengths AS (SELECT user_id, problem_id, max(seq) AS n FROM steps GROUP BY ALL),
starts AS (SELECT user_id, problem_id, n, unnest(range(2, n + 1)) AS k FROM lengths WHERE n >= 2),
grid AS (SELECT user_id, problem_id, k, unnest(range(1, least(5, n - k + 1) + 1)) AS step FROM starts),
rollouts AS (
  SELECT g.user_id, g.problem_id, g.k, g.step, t.seq,
    CASE WHEN (g.user_id + g.k + g.step) % 6 = 0 THEN 'exit()' ELSE coalesce(a.code, '') END AS code, a.grade AS grade, t.code AS student_code, t.grade AS student_grade,
    'm' || (g.user_id % 3)::VARCHAR AS model, ['BASE', 'SFT', 'DPO', 'GRPO', 'PARA'][g.user_id % 5 + 1] AS method
  FROM grid g JOIN steps t ON t.user_id = g.user_id AND t.problem_id = g.problem_id AND t.seq = g.k + g.step - 1
  LEFT JOIN steps a ON a.user_id = g.user_id AND a.problem_id = g.problem_id AND a.seq = g.k + g.step)"""


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollout_rows(spark, sf_dir)
    similar = F.when(F.col("code") == F.col("student_code"), 1.0).otherwise(0.25)
    made = reports.k_step_metrics(rows, similar)
    return made.select(F.col("user_id").alias("student_id"), "problem_id", F.col("k").alias("starting_position"), F.col("step").alias("k"), "has_ground_truth", "has_model_code", "has_valid_pair", "grade_difference", "grade_proximity", "codebleu", "model", "method", (F.col("student_grade") >= 50).alias("trajectory_solved"))


DETAILED = f"""{ROLLOUT}, flags AS (
  SELECT *, 1 AS has_ground_truth, CASE WHEN code IN ('', 'exit()') THEN 0 ELSE 1 END AS has_model_code FROM rollouts),
detailed AS (
  SELECT user_id AS student_id, problem_id, k AS starting_position, step AS k, has_ground_truth, has_model_code, has_model_code AS has_valid_pair,
    CASE WHEN has_model_code = 1 THEN abs(grade - student_grade) / 100.0 END AS grade_difference,
    CASE WHEN has_model_code = 1 THEN 1.0 - abs(grade - student_grade) / 100.0 END AS grade_proximity,
    CASE WHEN has_model_code = 1 THEN CASE WHEN code = student_code THEN 1.0 ELSE 0.25 END::DOUBLE END AS codebleu,
    model, method, student_grade >= 50 AS trajectory_solved FROM flags)"""
