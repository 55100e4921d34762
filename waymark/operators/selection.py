"""Exact medians by distributed selection.

A group's values are counted before they are shuffled.  While a group has more distinct values than
one task should sort, they are counted by ranges (RANGES parts between the least and
the greatest value) and only the range that holds the middle rank is looked at again; so what a
task sorts is bounded, whatever the group's size.  A round narrows the range a
thousandfold, after one that splits by sign; the state of the groups is checkpointed after each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable

#: Distinct values of a group that one task sorts, and the parts into which a wider range is cut.
MOST, RANGES = 1 << 18, 1024


def _range(value: Column, low: Column, high: Column) -> Column:
    """The number of the part that holds a value: by sign where signs differ, by equal ratios where
    the values span many magnitudes, else by equal widths.  Infinities and NaN lie outside."""
    below, size = high < 0, lambda x: F.ln(F.abs(x))
    ratio = (size(value) - size(low)) / (size(high) - size(low))
    width = (value / 2 - low / 2) / (high / 2 - low / 2)  # halves don't overflow
    magnitudes = F.when(below, low / high).otherwise(high / low) > 1 << 20
    part = F.least(F.floor(F.when(magnitudes, ratio).otherwise(width) * RANGES), F.lit(RANGES - 1))
    part = F.when(low == high, 0).when((low <= 0) & (high >= 0), F.signum(value) + 1).otherwise(part)
    return F.when(F.isnan(value), RANGES + 1).when(value == float("inf"), RANGES).when(value == float("-inf"), -1).otherwise(part).cast("int")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", most: int = MOST) -> DataFrame:
    """(keys, median): the middle value of each group, the mean of the two middle ones of an even number.

    Nulls don't count; a group of nulls has a null median; a null key is a key.  NaN is greater than any
    number.  Counts a first time to see how wide the groups are.
    """
    named = [f"_waymark_k{i}" for i in range(len(keys))]
    values = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(value).cast("double").alias("v"))
    counted = values.groupBy(*named, "v").agg(F.count("*").alias("c"))
    real = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    n = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
    state = counted.groupBy(*named).agg(n.alias("n"), F.count("v").alias("distinct"), F.min(real).alias("low"), F.max(real).alias("high"))
    state = state.select(*named, F.expr("(n + 1) div 2").alias("r1"), F.expr("n div 2 + 1").alias("r2"), F.lit(0).cast("long").alias("below"), "distinct", "low", "high", F.lit(None).cast("double").alias("found"), F.lit(True).alias("whole"))
    while (state.where("found is null").agg(F.max("distinct")).first()[0] or 0) > most:
        wide = F.col("found").isNull() & (F.col("distinct") > most)
        state = reliable(state.where(~wide).unionByName(_narrowed(counted, state.where(wide), named)))
    middle = _inside(counted, state.where("found is null"), named)
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*named).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    middle = middle.withColumn("upto", upto).where("upto >= r1 and upto - c < r2")
    # one value, or two neighbours
    middle = middle.groupBy(*named).agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.min("v") / 2 + F.max("v") / 2).alias("found"))
    done = state.where("found is not null").select(*named, "found").unionByName(middle)
    left, right = state.select(*named).alias("s"), done.alias("d")
    out = left.join(right, _same(named, "s", "d"), "left") if named else left.join(right, F.lit(True), "left")
    return out.select(*(F.col(f"s.{n}").alias(k) for k, n in zip(keys, named)), F.col("d.found").alias(name))


def _same(named: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in named))


def _inside(counted: DataFrame, state: DataFrame, named: Sequence[str]) -> DataFrame:
    """The counted values of each group's range, with its state."""
    both = counted.where("v is not null").alias("c").join(state.alias("s"), _same(named, "c", "s"))
    both = both.where(F.col("whole") | F.col("v").between(F.col("low"), F.col("high")))
    return both.select(*(F.col(f"c.{k}") for k in named), "v", "c", "r1", "r2", "below", "low", "high")


def _narrowed(counted: DataFrame, state: DataFrame, named: Sequence[str]) -> DataFrame:
    """Groups with the range that holds their middle ranks; the median itself where these are
    the last value of one range and the first of the next."""
    rows = _inside(counted, state, named).withColumn("part", _range(F.col("v"), F.col("low"), F.col("high")))
    parts = rows.groupBy(*named, "part", "r1", "r2", "below").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*named).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    hit = parts.withColumn("upto", upto).where("upto >= r1 and upto - n < r2")
    out = hit.groupBy(*named, "r1", "r2").agg(
        F.min(F.col("upto") - F.col("n")).alias("below"), F.sum("distinct").alias("distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.when(F.count("*") == 2, F.min("high") / 2 + F.max("low") / 2).alias("found"),
    )
    return out.withColumn("whole", F.lit(False))
