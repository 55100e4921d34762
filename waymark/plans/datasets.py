"""Plans that build trajectories and training datasets out of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import sequence as W
from ..operators.pairing import drawn_pairs


def structural_filter(log: DataFrame, least: float = 50.0, exams: bool = True, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Filters of a raw log in their defined order.

    Solved groups are judged on all rows; the canonical variant on those that survive the
    other filters.
    """
    log = log.withColumn("problem_group", X.group_prefix(F.col("problem_id")))
    rows = R.having_last_at_least(log, ["problem_id", "user"], "grade", order, least)
    rows = R.not_mentioning(rows, ["problem_description", "testcase"], ".csv")
    rows = rows.where(~F.coalesce("redacted", F.lit(False)) & (F.col("type") == "lab"))
    if not exams:
        rows = rows.where(~F.coalesce("exam", F.lit(False)))
    return R.canonical_variant(rows, "problem_group", "problem_id")


def build_trajectories(log: DataFrame, code_hash: Column, keys: Sequence[str] = ("user", "problem_id"), order: Sequence[str] = ("timestamp",), least_raw: int = 6, least_kept: int = 3, success: float = 100.0, regraded: str | None = None) -> DataFrame:
    """Steps of each trajectory: repeats removed, cut at the first success, void ones dropped.

    One partitioning by the keys serves every window.  With ``regraded`` trajectories whose
    recorded grades disagree are dropped after the cut, so nothing after it counts.
    """
    rows = R.at_least(log, keys, least_raw)
    steps = W.number_steps(rows.withColumn("code_hash", code_hash), keys, order)
    steps = W.without_repeats(steps, keys, "code_hash", "")
    steps = W.until_success(steps, keys, F.col("grade") >= success)
    if regraded:
        steps = W.without_mismatch(steps, keys, "grade", regraded)
    return R.at_least(steps, keys, least_kept)


def sft_rows(turns: DataFrame, keys: Sequence[str], budget: int, tokens: Column, split_key: str, percent: float = 20.0) -> DataFrame:
    """(keys, target, split, kept_from): an example for each fenced assistant turn.

    The split comes before the expansion, so all examples of a group lie on one side.  An
    example is named by its target position; its messages are those up to it, cut from the
    left by ``truncated_targets``, and only written out at the sink.
    """
    split = R.split_groups(turns.select(split_key).distinct(), split_key, percent)
    rows = W.truncated_targets(turns, keys, budget, tokens, W.is_target("pos", "role", "content"))
    return rows.join(split, split_key)


def example_messages(examples: DataFrame, turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages of each example as an array, for the sink."""
    rows = examples.select(*keys, "target", "kept_from").join(turns, list(keys)).where(F.col("pos") <= F.col("target"))
    rows = rows.where(F.col("kept_from").isNull() | (F.col("pos") >= F.col("kept_from")) | (F.col("pos") <= 1))
    return rows.groupBy(*keys, "target").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))


def preference_pairs(steps: DataFrame, keys: Sequence[str], strategy: str = "grade", per_trajectory: int | None = None, seed: str = "") -> DataFrame:
    """(keys, seq, rejected_seq, chosen, rejected) by a strategy: next, grade, temporal,
    greedy_grade, greedy_temporal, drawn_temporal."""
    made = {
        "next": lambda: W.next_pairs(steps, keys).select(*keys, "seq", "rejected_seq"),
        "grade": lambda: W.grade_pairs(steps, keys),
        "temporal": lambda: W.temporal_pairs(steps, keys, seed=seed),
        "greedy_grade": lambda: W.greedy_pairs(steps, keys, "grade"),
        "greedy_temporal": lambda: W.greedy_pairs(steps, keys, "temporal"),
        "drawn_temporal": lambda: drawn_pairs(steps, keys, "temporal", seed=seed),
    }[strategy]()
    if per_trajectory is not None:
        made = R.cap_per_group(made, keys, per_trajectory, [R.hash_order(*keys, "seq", seed=seed), F.col("seq")])
    code = steps.select(*keys, "seq", F.col("code").alias("chosen"))
    other = steps.select(*keys, F.col("seq").alias("rejected_seq"), F.col("code").alias("rejected"))
    return made.join(code, [*keys, "seq"]).join(other, [*keys, "rejected_seq"])


def within_length(pairs: DataFrame, columns: Sequence[str], tokens, limit: int, strict: bool = True) -> DataFrame:
    """Rows whose texts are all shorter than a limit (or not longer)."""
    for c in columns:
        pairs = pairs.where(tokens(F.col(c)) < limit if strict else tokens(F.col(c)) <= limit)
    return pairs


def grpo_rows(steps: DataFrame, keys: Sequence[str], per_trajectory: int = 1, most: int | None = None, seed: str = "") -> DataFrame:
    """Prompts with the code before, all later codes and their grades."""
    rows = W.with_remaining(W.with_previous(steps, keys), keys).where(F.col("previous_code").isNotNull())
    rows = R.cap_per_group(rows, keys, per_trajectory, [R.hash_order(*keys, "seq", seed=seed), F.col("seq")])
    return rows if most is None else R.sample_rows(rows, most, [*keys, "seq"], seed)


def truncation_counts(turns: DataFrame, keys: Sequence[str], budget: int, tokens: Column) -> DataFrame:
    """One row: conversations, those cut, and those whose opening alone is over the budget."""
    kept = W.truncate_left(turns, keys, budget, tokens).groupBy(*keys).agg(F.max(F.col("truncated").cast("int")).alias("cut"))
    every = turns.select(*keys).distinct().join(kept, list(keys), "left")
    return every.agg(F.count("*").alias("n"), F.sum(F.coalesce("cut", F.lit(0))).alias("n_truncated"), F.sum(F.col("cut").isNull().cast("long")).alias("n_rejected"))


def write_truncated(turns: DataFrame, keys: Sequence[str], budget: int, tokens: Column, path: str) -> tuple[str, dict[str, int]]:
    """Writes what ``truncate_left`` keeps; (path, n, n_truncated and n_rejected conversations),
    counted in the job that writes."""
    counted = Observation()
    W.truncate_left(turns, keys, budget, tokens, counted=counted).write.parquet(path)
    return path, counted.get
