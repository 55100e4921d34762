"""Numeric expressions: ratios, bins, grades, rewards and penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, is_recording


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b > 0."""
    return F.when(b > 0, a / b)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def decile(x: Column) -> Column:
    """Nearest tenth, half to even."""
    return F.bround(x * 10, 0) / 10


def round3(x: Column) -> Column:
    """Three decimals, half to even.

    Rounding to nine first removes what the order of a floating sum leaves, so that a tie
    is a tie on any partitioning.
    """
    return F.bround(F.round(x, 9), 3)


def whole_grade(grade: Column) -> Column:
    """Nearest integer, half to even; null stays."""
    return F.bround(grade, 0)


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def pair_flags(truth: Column, answer: Column) -> dict[str, Column]:
    """0/1 columns: there is a true program, a model's program, both."""
    has_truth = (clean(truth) != "").cast("int")
    has_answer = (~is_recording(answer)).cast("int")
    return {"has_ground_truth": has_truth, "has_model_code": has_answer, "has_valid_pair": has_truth * has_answer}


def grade_difference(predicted: Column, true: Column, valid: Column) -> Column:
    """|p - t| / 100, null unless the pair is valid and both grades are known."""
    return F.when(valid == 1, F.abs(whole_grade(predicted) - whole_grade(true)) / 100.0)


def length_penalty(length: Column, limit: int, used: float = 0.95, soft: float = 0.1) -> Column:
    """0 up to the soft zone, falling to -1 at the maximum and beyond."""
    most = int(limit * used)
    zone = int(most * soft)
    return F.when(length <= most - zone, 0.0).when(length <= most, ((most - zone) - length) / float(zone)).otherwise(-1.0)


def reward(has_fence: Column, compiles: Column, ran: Column, same_code: Column, grade: Column, target: Column, penalty: Column) -> Column:
    """Base reward by the first case that holds, plus half the penalty, at least -0.75."""
    base = F.when(~has_fence, -1.0).when(~compiles, -0.5).when(~ran, 0.0).when(same_code, 2.0).when(F.abs(grade - target) < 1e-6, 1.0).otherwise(0.0)
    return F.greatest(base + 0.5 * penalty, F.lit(-0.75))
