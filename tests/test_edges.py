"""Core operators on empty tables, null keys and columns named like their own."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import relational as R
from waymark.operators import sequence as W

KEYS = ["user", "task"]
ROWS = [("a", "t", 1, "x", 10.0), ("a", "t", 2, "y", 10.0), ("a", "t", 3, "z", 20.0), ("b", "t", 1, "x", None), ("b", "t", 2, "y", 5.0), (None, "t", 1, "x", 1.0), (None, "t", 2, "y", 2.0)]
SCHEMA = "user string, task string, seq int, code string, grade double"
OWN = "_rank _n _median _off _mad _before _won _tok _place _last _hash _val _part _start _head _done _one _rest".split()


def _turns(df):
    return df.select(*KEYS, F.col("seq").alias("pos"), F.when(F.col("seq") % 2 == 0, "assistant").otherwise("user").alias("role"), F.col("code").alias("content"), *(c for c in df.columns if c.startswith("_")))


OPERATORS = {
    "having_last_at_least": lambda df: R.having_last_at_least(df, ["user"], "grade", ["seq"], 5),
    "not_mentioning": lambda df: R.not_mentioning(df, ["code"], "z"),
    "canonical_variant": lambda df: R.canonical_variant(df, "task", "user"),
    "without_outliers": lambda df: R.without_outliers(df, "user", "grade"),
    "at_least": lambda df: R.at_least(df, KEYS, 2),
    "first_per_key": lambda df: R.first_per_key(df, ["user"], ["seq"]),
    "sample_rows": lambda df: R.sample_rows(df, 3, ["user", "seq"]),
    "split_groups": lambda df: R.split_groups(df, "user", 50),
    "number_rows": lambda df: R.number_rows(df, ["user", "seq"], "place"),
    "cap_per_group": lambda df: R.cap_per_group(df, ["user"], 1, ["seq"]),
    "without_repeats": lambda df: W.without_repeats(df, KEYS, "code"),
    "until_success": lambda df: W.until_success(df, KEYS, F.col("grade") >= 10),
    "without_mismatch": lambda df: W.without_mismatch(df, KEYS, "grade", "grade"),
    "with_previous": lambda df: W.with_previous(df, KEYS),
    "next_pairs": lambda df: W.next_pairs(df, KEYS, code_hash="code", first=1),
    "with_remaining": lambda df: W.with_remaining(df, KEYS),
    "truncate_left": lambda df: W.truncate_left(_turns(df), KEYS, 2, F.lit(1)),
    "truncate_pairs": lambda df: W.truncate_pairs(_turns(df), KEYS, 2, F.lit(1)),
    "cleaned_prompt": lambda df: W.cleaned_prompt(_turns(df), KEYS, "pos", "role", "content"),
    "recording_mode": lambda df: W.recording_mode(df.withColumnsRenamed({"seq": "step"}).withColumn("k", F.lit(1)), KEYS, F.col("grade") >= 10),
}
PAIRS = {"grade_pairs": lambda df: W.grade_pairs(df, KEYS), "temporal_pairs": lambda df: W.temporal_pairs(df, KEYS, "code", 1), "greedy_pairs": lambda df: W.greedy_pairs(df, KEYS, code_hash="code")}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name_pass(rows, name):
    clashing = rows
    for c in OWN:
        clashing = clashing.withColumn(c, F.lit("other"))
    plain, out = OPERATORS[name](rows), OPERATORS[name](clashing)
    assert {c for c in out.columns if c in OWN} == set(OWN) and out.where(" or ".join(f"{c} <> 'other'" for c in OWN)).count() == 0
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS | PAIRS))
def test_empty_tables(rows, name):
    assert (OPERATORS | PAIRS)[name](rows.limit(0)).count() == 0


@pytest.mark.parametrize("name,left", [("having_last_at_least", 0), ("at_least", 0), ("without_outliers", 2), ("first_per_key", 1), ("until_success", 2), ("cap_per_group", 1), ("split_groups", 2)])
def test_null_keys(rows, name, left):
    assert OPERATORS[name](rows).where("user is null").count() == left


def test_grade_pairs_by_definition(spark):
    log = spark.createDataFrame([("a", "t", i, "", None if g < 0 else float(g)) for i, g in enumerate([5, 5, -1, 7, -1, 7, 5, 5, 9, 9], 1)], SCHEMA)
    out = {r["seq"]: r["rejected_seq"] for r in W.grade_pairs(log, KEYS).collect()}
    assert out == {1: 4, 2: 4, 4: 7, 6: 7, 7: 9, 8: 9}
