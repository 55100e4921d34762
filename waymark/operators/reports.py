"""Aggregates of rollout metrics: coverage, proximity, degradation, strata, progression.

A detailed row has student_id, problem_id, starting_position, k and labels, the 0/1
columns has_ground_truth, has_model_code and has_valid_pair, and metrics that are null
(never NaN) where they don't apply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import clip, decile, grade_difference, pair_flags, ratio, round3, standard_error
from ..functions.text import is_recording

METRICS = ("coverage", "grade_proximity", "codebleu")


def k_step_metrics(rows: DataFrame, similarity: Column | None = None, steps: int = 5) -> DataFrame:
    """Detailed rows of rollout results (code, student_code, grade, student_grade by step)."""
    flags = pair_flags(F.col("student_code"), F.col("code"))
    out = rows.where(F.col("step").between(1, steps)).withColumns(flags)
    out = out.withColumn("grade_difference", grade_difference(F.col("grade"), F.col("student_grade"), F.col("has_valid_pair")))
    out = out.withColumn("grade_proximity", 1.0 - F.col("grade_difference"))
    return out if similarity is None else out.withColumn("codebleu", F.when(F.col("has_valid_pair") == 1, similarity))


def coverage_by(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("grade_proximity",), digits: bool = True) -> DataFrame:
    """Rows, coverage and metric means of each group, in one aggregation."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum("has_valid_pair").alias("valid"), F.sum("has_ground_truth").alias("truth"), *(F.avg(m).alias(m) for m in metrics)
    )
    out = sums.withColumn("coverage", ratio(F.col("valid"), F.col("truth"))).drop("valid", "truth")
    return out.withColumns({m: round3(F.col(m)) for m in ("coverage", *metrics)}) if digits else out


def macro(by_k: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means over k of (already rounded) means by k."""
    return by_k.groupBy(*keys).agg(*(round3(F.avg(m)).alias(m) for m in metrics))


def micro(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means over rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(round3(F.avg(m)).alias(m) for m in metrics))


def degradation(by_k: DataFrame, keys: Sequence[str], metrics: Sequence[str], last: int = 5) -> DataFrame:
    """Mean over k = 2..last of metric[k] - metric[1]; groups without k = 1 are dropped.

    Where a key has several rows of one k, the first by all other columns counts.
    """
    rest = [c for c in by_k.columns if c not in (*keys, "k")]
    first = by_k.withColumn("_waymark_rank", F.row_number().over(Window.partitionBy(*keys, "k").orderBy(*rest))).where("_waymark_rank = 1").drop("_waymark_rank")
    w = Window.partitionBy(*keys)
    rows = first.withColumns({f"_waymark_{m}": F.max(F.when(F.col("k") == 1, F.col(m))).over(w) for m in metrics}).withColumn("_waymark_one", F.max((F.col("k") == 1).cast("int")).over(w))
    later = F.col("k").between(2, last)
    return rows.where("_waymark_one = 1").groupBy(*keys).agg(*(F.avg(F.when(later, F.col(m) - F.col(f"_waymark_{m}"))).alias(f"delta_{m}") for m in metrics))


def averaged_with_degradation(by_k: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return macro(by_k, keys, metrics).join(degradation(by_k, keys, metrics), list(keys), "left")


def stratified(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], flag: str = "trajectory_solved") -> DataFrame:
    """Means over all rows, solved and unsolved ones; over all of them if no flag is known."""
    known = F.count(flag)
    out = []
    for m in metrics:
        whole = F.avg(m)
        out.append(round3(whole).alias(f"{m}_all"))
        for name, value in (("solved", True), ("unsolved", False)):
            part = F.avg(F.when(F.col(flag) == F.lit(value), F.col(m)))
            out.append(round3(F.when(known == 0, whole).otherwise(part)).alias(f"{m}_{name}"))
    return rows.groupBy(*keys).agg(*out)


def best_per_group(table: DataFrame, group: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6, lower: Sequence[str] = ()) -> DataFrame:
    """Adds best_<metric>: within a tolerance of the group's greatest, of its least for the metrics in ``lower``."""
    w = Window.partitionBy(*group)
    best = lambda m: (F.min if m in lower else F.max)(m).over(w)
    return table.withColumns({f"best_{m}": F.abs(F.col(m) - best(m)) < tolerance for m in metrics})


def six_metrics(by_k: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """A row for each key: mean of each metric over k and its degradation (delta_<metric>, three
    decimals; the greatest, which is nearest to no loss, is the best), with best_<column> among the rows
    of the first key."""
    table = averaged_with_degradation(by_k, keys, metrics)
    table = table.withColumns({f"delta_{m}": round3(F.col(f"delta_{m}")) for m in metrics})
    return best_per_group(table, keys[:1], [*metrics, *(f"delta_{m}" for m in metrics)])


def grade_lines(rows: DataFrame, model: str, method: str, reference: str, true: str = "true_grade", predicted: str = "pred_grade") -> DataFrame:
    """(model, line, position, mean, std, n, se, low, high): in one frame for each model but the
    reference the students' own line, each method's and the reference model's.

    Rows are those of ``with_position`` with grades of 0 to 100; each row serves its lines by an
    explode, so one aggregation makes all of them.
    """
    models = [r[0] for r in rows.where(F.col(model) != reference).select(model).distinct().limit(1001).collect()]
    if len(models) > 1000:
        raise ValueError("a report of over 1,000 models isn't a report")
    line = lambda name, grade: F.struct(name.alias("line"), (grade / 100.0).alias("grade"))
    own = rows.where(F.col(model) != reference).select(F.col(model).alias("of"), "position", F.explode(F.array(line(F.lit("student"), F.col(true)), line(F.col(method), F.col(predicted)))).alias("x"))
    of_all = rows.where(F.col(model) == reference).select("position", line(F.lit(reference), F.col(predicted)).alias("x"))
    made = progression(own.select(F.col("of").alias("model"), "position", "x.line", "x.grade"), ["model", "line", "position"], "grade")
    known = progression(of_all.select("position", "x.line", "x.grade"), ["line", "position"], "grade")
    each = F.explode(F.array(*map(F.lit, models)).cast("array<string>"))  # the reference's line beside each model's
    return made.unionByName(known.withColumn("model", each))


def with_position(rows: DataFrame, keys: Sequence[str] = ("student_id", "problem_id")) -> DataFrame:
    """Adds absolute_position, and position: its share of the trajectory's greatest, by tenths."""
    out = rows.withColumn("absolute_position", F.col("starting_position") + F.col("k") - 1)
    share = F.col("absolute_position") / F.greatest(F.max("absolute_position").over(Window.partitionBy(*keys)), F.lit(1))
    return out.withColumn("normalized_position", clip(share)).withColumn("position", decile(clip(share)))


def progression(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean, deviation, count, standard error and 95% interval of each key."""
    stats = rows.where(F.col(metric).isNotNull()).groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"), standard_error(F.col(metric)).alias("se"))
    return stats.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def plotted_coverage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answers over true programs, at most 1: the plots' coverage differs from the tables'."""
    sums = rows.groupBy(*keys).agg(F.sum("has_model_code").alias("answers"), F.sum("has_ground_truth").alias("truth"))
    return sums.withColumn("coverage", clip(F.col("answers") / F.greatest(F.col("truth"), F.lit(1)))).drop("answers", "truth")


def melted(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row for each metric."""
    return table.unpivot(list(keys), list(metrics), "metric", "value")


def reference_line(rows: DataFrame, model: str, value: str, metric: str) -> DataFrame:
    """Mean of one model by k."""
    return rows.where(F.col(model) == value).groupBy("k").agg(F.avg(metric).alias(metric))


def experiment_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("student_id").alias("n_students"), F.count_distinct("problem_id").alias("n_problems"), ratio(F.sum("has_valid_pair"), F.sum("has_ground_truth")).alias("coverage"))


def recording_share(rows: DataFrame, code: str = "code") -> DataFrame:
    return rows.agg(F.sum(is_recording(F.col(code)).cast("long")).alias("recording"), F.count("*").alias("n_rows"))


def latex_rows(table: DataFrame, group: str, label: str, metrics: Sequence[str], listed: Sequence[str] = ()) -> str:
    """Lines of a LaTeX table body, best value of a group in bold.

    A report has a row for each model and method: its table is collected after it has been
    checked to be that small.
    """
    marked = best_per_group(table, [group], metrics)
    place = F.array_position(F.array(*map(F.lit, listed)), F.col(label)) if listed else F.lit(0)
    rows = marked.orderBy(group, F.when(place == 0, 1 << 30).otherwise(place), label).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a table of over 10,000 rows isn't a report")
    show = lambda v, best: "--" if v is None else f"\\textbf{{{v:.3f}}}" if best else f"{v:.3f}"
    lines = (" & ".join([str(r[group]), str(r[label]), *(show(r[m], r[f"best_{m}"]) for m in metrics)]) for r in rows)
    return "".join(f"{line} \\\\\n" for line in lines)
