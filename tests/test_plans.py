"""What the plans must look like at any size: pushed filters, pruned columns, few shuffles."""

import re

import pytest

from waymark.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


def test_filters_and_columns_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["conjunction"](spark, sf))
    assert "GreaterThan(l_quantity,25.0)" in text and "EqualTo(l_linestatus,O)" in text
    assert "l_extendedprice" not in text and "Exchange" not in text


@pytest.mark.parametrize("name,most", [("chronological", 1), ("dedup_consecutive", 1), ("stop_at_success", 1), ("void_mismatch", 1), ("pairs_next", 1), ("remaining_trajectory", 1), ("left_truncate", 1), ("pair_truncate", 1), ("cap_per_group", 1), ("coverage_by_k", 8)])
def test_windows_of_a_trajectory_share_a_shuffle(spark, sf, name, most):
    assert shuffles(QUERIES[name](spark, sf)) <= most


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_text_functions_stay_in_the_jvm(spark, sf):
    for name in ("fence_last", "student_code", "score_parse", "tag_strip", "reward", "kstep_metrics", "degradation"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, sf)))


@pytest.mark.parametrize("name", ["pairs_temporal_relaxed", "pairs_temporal_drawn", "pairs_temporal_greedy", "pairs_grade_greedy", "random_choice"])
def test_no_step_meets_another(spark, sf, name):
    """Pairs are found in one pass over sorted trajectories: one shuffle by trajectory beside the numbering, no join."""
    text = plan(QUERIES[name](spark, sf))
    assert "Join" not in text and shuffles(QUERIES[name](spark, sf)) <= 2


def test_examples_share_a_shuffle(spark, sf):
    """Contexts of targets come from running sums: turns are never joined with turns."""
    text = plan(QUERIES["sft_truncated"](spark, sf))
    assert len(re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", text)) <= 3  # of the split
