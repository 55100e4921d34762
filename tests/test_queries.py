"""Every query against its SQL; queries without SQL against what is known of them."""

import pytest
from compare import connect, same

from waymark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rollout_rows(spark, sf):
    """A task has min(rounds, n - k + 1) rows, and nothing is generated after it ends."""
    rows = QUERIES["rollout_loop"](spark, sf).toPandas()
    for _, task in rows.groupby(["user_id", "problem_id", "k"]):
        task = task.sort_values("step")
        assert list(task["step"]) == list(range(1, len(task) + 1)) and len(task) <= 3
        done = task["grade"].ge(100).values.argmax() if task["grade"].ge(100).any() else len(task)
        assert (task["code"].values[done + 1 :] == "").all()
        assert (task["mode"].values[done + 1 :] == "recording").all()
