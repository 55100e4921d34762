"""Golden and property tests of the functions on programs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import code as C


def test_hash_ignores_names():
    a = "def f(x):\n    y = x + 1\n    return y\n"
    assert C.code_hash(a) == C.code_hash(a.replace("x", "q").replace("y", "r").replace("f(", "g("))
    assert C.code_hash(a) != C.code_hash(a.replace("1", "2"))
    assert C.code_hash("") == "" and C.code_hash("if:") == C.code_hash("if :") != C.code_hash("if:)")


def test_tokens():
    assert C.tokens_with_comments("x = 1  # a\n") == ["x", "=", "1", "# a"]
    assert C.tokens_with_indents("if x:\n    y\n") == ["if", "x", ":", "    ", "y", ""]
    assert C.tokens_with_comments("'''") is None and C.tokens_with_indents("'''") == []


def test_distances():
    assert C.token_distance("x = 1", "x = 1") == 0 and C.token_distance("x = (", "x = 1") == 1
    assert C.tree_edits("x = 1", "y = 2") == 0 and C.tree_edits("x = 1", "x = 1 + 2") == 3
    assert C.tree_edits("x = (", "x") is None
    assert C.bleu_distance("a b c d e", "a b c d e") == pytest.approx(0)
    assert C.rouge_distance("a b", "a c") == pytest.approx(0.5) and C.rouge_distance("a b", "b a", 0) == pytest.approx(0.5)
    assert C.codebleu("", "x") == 0 and C.codebleu("x = 1\n", "x = 1\n") == pytest.approx(1.0)


def test_diff_edges():
    assert C.parse_diff("@@ -3,2 +3 @@\n-- a comment\n b\n+c")[0] == {"old_start": 3, "changes": [{"op": "-", "line": "- a comment"}, {"op": " ", "line": "b"}, {"op": "+", "line": "c"}]}
    assert C.apply_diff("a\nb\nc", "@@ -9 +9 @@\n-b\n+x") == "a\nx\nc"  # wrong number
    assert C.apply_diff("a\nb", "@@ -1,0 +2 @@\n+x") == "a\nx\nb"  # insertion only
    assert C.apply_diff("a\nb\nc", "@@ -2 +1,0 @@\n-b") == "a\nc"  # deletion only
    assert C.apply_diff("x\nx\nx", "@@ -2 +2 @@\n-x\n+y") == "x\ny\nx"  # nearest of equals
    assert C.apply_diff("total_sum = value + 10", "@@ -1 +1 @@\n-total_sum = value + 11\n+y") == "y"  # fuzzy
    assert C.apply_diff("a", "") == "a"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), unique=True, max_size=12), st.lists(st.integers(0, 40), unique=True, max_size=12))
def test_diff_round_trip(a, b):
    """On distinct lines a generated diff leads to the new program."""
    before, after = ("\n".join(f"line{x:02d} = {x * x * 7919}" for x in s) for s in (a, b))
    assert C.apply_diff(before, C.unified_diff(before, after)) == after


def test_reconstruct():
    said = ["```python\na\nb\n```", "words", "```diff\n@@ -2 +2 @@\n-b\n+c\n```"]
    assert C.reconstruct(said) == "a\nc" and C.reconstruct(["```diff\n@@ -1 +1 @@\n+x\n```"]) is None


def test_representation():
    a = "a\nb\nc\nd\ne\nf"
    assert C.representation(None, a) == "full" and C.representation(a, a.replace("c", "x")) == "diff"
    assert C.representation(a, "q") == "full" and C.representation(a, a, "progression", True) == "full" and C.representation(a, a, "progression") == "diff"


def test_grading():
    from waymark.plans.grading import run_program

    assert run_program("print(input())", "score = 100 if program_output.strip() == 'hi' else 0", ["hi"])["score"] == 100
    assert run_program("if:")["error"] == "SyntaxError"
    assert "ZeroDivisionError" in run_program("1/0")["error"]
    assert run_program("while True: pass", seconds=1)["score"] is None
    assert run_program("import sys; sys.exit()")["error"] is None


def test_grading_rows(spark):
    from waymark.plans.grading import grade_programs

    rows = spark.createDataFrame([(1, "x = 2", "score = 100"), (2, "x = (", "score = 100"), (3, None, None)], "id int, code string, testcase string")
    assert {r["id"]: r["new_grade"] for r in grade_programs(rows, ["id"]).collect()} == {1: 100.0, 2: 0.0, 3: 0.0}


def test_a_repeated_program_is_worked_on_once(monkeypatch):
    calls = []
    known = C._Known(lambda *row: calls.append(row) or len(row[0]))
    assert [known(x, y) for x, y in [("a", "b"), ("a", "b"), ("a", "c"), ("a", "b")]] == [1] * 4 and calls == [("a", "b"), ("a", "c")]
    monkeypatch.setattr(C, "HELD", 1000)
    assert [known(f"{i % 50}", "x" * 100) for i in range(200)] == [len(f"{i % 50}") for i in range(200)] and known.size <= 1000
    assert known("x" * 2000, "") == 2000 and known.size <= 1000 and known(["a"], "b") == 1


def test_shapes_of_trees_are_compared_once():
    C._shape_edits.cache_clear()
    assert [C.tree_edits(f"x = {i}", f"y{i} = f({i})") for i in range(20)] == [C.tree_edits("a = 1", "b = g(2)")] * 20
    assert C._shape_edits.cache_info().misses == 1


def test_programs_are_dealt_out(spark, sf):
    """The table's one split mustn't make one task of all programs."""
    from waymark.queries import code_queries as Q

    for made in (Q._programs, Q._worn_programs, Q.code_distances, Q.codebleu, Q.representations):
        sizes = made(spark, sf).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == 4, made
