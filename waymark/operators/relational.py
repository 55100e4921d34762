"""Filters, joins, aggregates, sampling and splits over submission logs.

All are compositions of DataFrame operations; none collects rows or names a physical
strategy, apart from broadcasts of what is checked to be small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable
from .selection import medians

#: A lookup table is broadcast up to this many rows; beyond it the planner decides.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows; reads at most rows + 1."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over the session's number of shuffle partitions, which aren't merged again: for
    narrow rows before costly functions, as a scan may have one split where there are many cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def last_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys and the value of the last row in order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def having_last_at_least(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], least: float) -> DataFrame:
    """All rows of the groups whose last value reaches ``least``; a group whose last is null goes,
    and so do rows with a null key."""
    return df.join(last_value(df, keys, value, order).where(F.col(value) >= least), list(keys), "left_semi")


def not_mentioning(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows of which no column contains text; null contains nothing."""
    return df.where(reduce(lambda a, b: a & b, (~F.coalesce(F.contains(c, F.lit(text)), F.lit(False)) for c in columns)))


def canonical_variant(df: DataFrame, group: str, variant: str) -> DataFrame:
    """Rows with the most frequent variant of their group, the least of several; rows with a
    null group or variant go."""
    best = variants(df, group, variant)
    return df.join(best, [group, variant], "left_semi")


def variants(df: DataFrame, group: str, variant: str) -> DataFrame:
    """(group, variant, n): each group's most frequent variant.

    Counts are combined before the shuffle, so a frequent pair costs one row a task.
    """
    counts = df.groupBy(group, variant).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.min_by(F.struct(variant, "n"), F.struct(-F.col("n"), F.col(variant))).alias("best"))
    return best.select(group, f"best.{variant}", "best.n")


def without_outliers(df: DataFrame, group: str, value: str, limit: float = 3.5) -> DataFrame:
    """Rows whose modified z-score 0.6745 * |x - median| / MAD is within the limit.

    A group with MAD 0 is kept whole; a null value is kept.  Medians are exact and no task sorts
    a whole group.
    """
    middle = medians(df, [group], value, "_waymark_median")
    off = F.abs(F.col(value) - F.col("_waymark_median"))
    near = df.join(middle, df[group].eqNullSafe(middle[group])).drop(middle[group]).withColumn("_waymark_off", off)
    spread = medians(near, [group], "_waymark_off", "_waymark_mad")
    out = near.join(spread, near[group].eqNullSafe(spread[group])).drop(spread[group])
    fine = (F.col("_waymark_mad") == 0) | (F.lit(0.6745) * F.col("_waymark_off") / F.col("_waymark_mad") <= limit)
    return out.where(F.coalesce(fine, F.lit(True))).drop("_waymark_median", "_waymark_off", "_waymark_mad")


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups of n rows or more; rows with a null key go."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_waymark_n")).where(F.col("_waymark_n") >= n), list(keys), "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_waymark_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_waymark_rank = 1").drop("_waymark_rank")


def lookup_first(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the least value of each key that isn't null."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def hash_order(*columns: str, seed: str = "") -> Column:
    """A random-looking order that depends on values alone, not on partitions."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: str = "") -> DataFrame:
    """n rows, the same ones at every run: those of least hash of their keys."""
    return df.orderBy(hash_order(*keys, seed=seed), *keys).limit(n)


def split_groups(df: DataFrame, key: str, percent: float, seed: str = "") -> DataFrame:
    """df with ``split``: floor(percent% of the groups) are 'val', the others 'train'.

    Groups are ranked by hash.  The rank comes from a global sort of the keys in ranges:
    each range's rows are numbered after those of the ranges before it.
    """
    groups = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = number_rows(groups.withColumn("_waymark_hash", hash_order(key, seed=seed)), ["_waymark_hash", key], "_waymark_rank")
    limit = math.floor(groups.count() * percent / 100)
    chosen = ranked.where(F.col("_waymark_rank") <= limit).select(F.col(key).alias("_waymark_val"))
    return df.join(chosen, df[key] == F.col("_waymark_val"), "left").withColumn("split", F.when(F.col("_waymark_val").isNotNull(), "val").otherwise("train")).drop("_waymark_val")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with a 1-based global row number in an order that must be total.

    Sorted ranges are counted (one row a range), and a running sum over these few counts
    gives each its start: no single task sees all rows.
    """
    # checkpointed: the ranges are sampled, and another evaluation might place a row elsewhere
    spread = reliable(df.repartitionByRange(*order).withColumn("_waymark_part", F.spark_partition_id()))
    starts = spread.groupBy("_waymark_part").agg(F.count("*").alias("_waymark_n"))
    before = F.sum("_waymark_n").over(Window.orderBy("_waymark_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("_waymark_part", F.coalesce(before, F.lit(0)).alias("_waymark_before"))
    inner = F.row_number().over(Window.partitionBy("_waymark_part").orderBy(*order))
    out = spread.withColumn("_waymark_inner", inner).join(F.broadcast(starts), "_waymark_part")
    return out.withColumn(name, F.col("_waymark_before") + F.col("_waymark_inner")).drop("_waymark_part", "_waymark_inner", "_waymark_before")


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column | str]) -> DataFrame:
    """At most n rows of each group, the first in order."""
    return df.withColumn("_waymark_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_waymark_rank") <= n).drop("_waymark_rank")


def in_listed_order(df: DataFrame, column: str, listed: Sequence[str]) -> DataFrame:
    """Sorted by position in a list; values that aren't in it follow by name."""
    place = F.array_position(F.array(*map(F.lit, listed)), F.col(column))
    return df.orderBy(F.when(place == 0, len(listed) + 1).otherwise(place), column)


def map_values(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped value, else the value itself."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def keep_existing(df: DataFrame, listed: Sequence[str]) -> DataFrame:
    """The listed columns in their order, without those that df lacks."""
    return df.select(*(F.col(f"`{c}`") for c in listed if c in df.columns))


def without_empty_columns(df: DataFrame, unnamed: str = "Unnamed") -> DataFrame:
    """df without columns that hold only nulls and without unnamed ones; one pass."""
    named = [c for c in df.columns if not c.startswith(unnamed)]
    counts = df.select(*(F.count(c).alias(c) for c in named)).first()
    return df.select(*(c for c in named if counts[c]))


def reorder_by_request(requests: DataFrame, responses: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every request with its response, null where none came; the first of several."""
    return requests.join(first_per_key(responses, [key], [F.col(c) for c in responses.columns if c != key]), key, "left")


def group_statistics(df: DataFrame, user: str, problem: str, length: str, final: str, success: float = 100.0) -> DataFrame:
    """One row: counts, mean length, solved and unsolved rows, mean and median final grade."""
    won = F.coalesce(F.col(final) >= success, F.lit(False))
    middle = medians(df.select(F.lit(0).alias("all"), F.col(final).alias("final")), ["all"], "final").first()
    return df.agg(
        F.count("*").alias("n_trajectories"), F.count_distinct(user).alias("n_users"), F.count_distinct(problem).alias("n_problems"), F.avg(length).alias("avg_length"),
        F.sum(won.cast("long")).alias("n_solved"), F.sum((~won).cast("long")).alias("n_unsolved"), F.avg(final).alias("avg_final"), F.lit(middle["median"] if middle else None).cast("double").alias("median_final"),
    )


def representatives(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, text, n): the most frequent raw text of each key, the least of several."""
    counts = df.groupBy(*keys, text).agg(F.count("*").alias("n"))
    return first_per_key(counts, keys, [F.desc("n"), F.col(text)])


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str, bits: int = 14) -> DataFrame:
    """(keys, sketch): HyperLogLog sketches of a column's distinct values, some 2**bits bytes
    each.  Stored sketches of splits or days are united without the rows (``united_sketches``)."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, bits).alias("sketch"))


def united_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of fewer keys, each the union of those that share them."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_distinct(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """Estimates of sketches: with 14 bits the standard error is 0.6 per cent."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
