"""Golden cases of rollouts, grading and templates."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import code as C
from waymark.functions import text as X
from waymark.plans import rollout as P
from waymark.plans.grading import grader, run_program

KEYS = ["user", "task"]


def _log(spark, codes):
    steps = spark.createDataFrame([("a", "t", i, c, 0.0) for i, c in enumerate(codes, 1)], "user string, task string, seq int, code string, grade double")
    turns = [("a", "t", 0, "system", "Go"), ("a", "t", 1, "user", "Problem")]
    for i, c in enumerate(codes, 1):
        turns += [("a", "t", 2 * i, "assistant", f"```python\n{c}\n```"), ("a", "t", 2 * i + 1, "user", f"seen {i}")]
    return steps, spark.createDataFrame(turns, "user string, task string, pos int, role string, content string")


#: The prompt itself, as a comment of a program.
_echo = lambda conversations: ["```python\n# " + " | ".join(f"{m['role']}:{m['content'][:40]}" for m in ms).replace("\n", "~") + "\n```" for ms in conversations]


def test_feedback_follows_each_answer(spark):
    steps, turns = _log(spark, ["x = 1", "x = 2", "x = 3"])
    grade = lambda rows: rows.withColumn("grade", F.lit(10.0)).withColumn("feedback", F.concat(F.lit("try "), F.col("step").cast("string")))
    out = P.rollout(steps, turns, KEYS, _echo, grade, rounds=2).where("k = 2").orderBy("step").collect()
    assert out[0]["code"] == "# system:Go | user:Problem | assistant:x = 1~ | user:seen 1"
    assert out[1]["code"].startswith("# system:Go | user:Problem | assistant:x = 1~ | user:seen 1 | assistant:# system:Go") and out[1]["code"].endswith("| user:try 1")


def test_order_beyond_500_submissions(spark):
    steps, turns = _log(spark, [f"x = {i}" for i in range(503)])
    tail = lambda ms: "```python\n# " + " | ".join(m["role"] + ":" + m["content"][:8].strip() for m in ms[-3:]).replace("\n", "~") + "\n```"
    grade = P.by_column(lambda code: F.lit(0.0))
    out = P.rollout(steps, turns, KEYS, lambda cs: [tail(ms) for ms in cs], grade, rounds=2, start=502).where("k = 502").orderBy("step").collect()
    assert out[0]["code"] == "# user:seen 500 | assistant:x = 500 | user:seen 501"
    assert out[1]["code"] == "# user:seen 501 | assistant:# user:s | user:Unit Tes"


def test_a_diff_is_applied(spark):
    steps, turns = _log(spark, ["a\nb", "c"])
    grade = P.by_column(lambda code: F.when(code == "a\nz", 100.0).otherwise(0.0))
    out = P.rollout(steps, turns, KEYS, lambda cs: ["```diff\n@@ -2 +2 @@\n-b\n+z\n```" for _ in cs], grade, rounds=1).collect()
    assert [(r["code"], r["successful"]) for r in out] == [("a\nz", True)]


def test_pairs_go_until_a_prompt_fits(spark):
    steps, turns = _log(spark, ["x = 1", "x = 2", "x = 3", "x = 4"])
    grade = P.by_column(lambda code: F.lit(0.0))
    out = {r["k"]: r for r in P.rollout(steps, turns, KEYS, _echo, grade, rounds=1, budget=25, tokens=F.length).collect()}
    assert out[4]["code"] == "# system:Go | user:Problem | assistant:x = 3~ | user:seen 3" and "x = 1" not in out[4]["code"] and "seen 3" in out[4]["code"]
    none = P.rollout(steps, turns, KEYS, _echo, grade, rounds=2, budget=12, tokens=F.length).collect()
    assert len(none) == 5 and all(r["over_budget"] == (r["step"] == 1) and r["code"] == "" and r["mode"] == "recording" for r in none)
    with pytest.raises(ValueError):
        P.rollout(steps, turns, KEYS, _echo, grade, budget=1)


def test_programs_are_graded_within_a_rollout(spark):
    steps, turns = _log(spark, ["print(1)", "print(2)", "print(3)"])
    tests = spark.createDataFrame([("t", "score = 100 if program_output.strip() == '7' else 20")], "task string, testcase string")
    answer = lambda cs: ["```python\nprint(7)\n```" if any("Returned: 20.0" in m["content"] for m in ms) else "```python\nprint(6)\n```" for ms in cs]
    out = P.rollout(steps, turns, KEYS, answer, grader(tests, ["task"]), rounds=2).where("k = 2").orderBy("step").collect()
    assert [(r["grade"], r["successful"]) for r in out] == [(20.0, False), (100.0, True)]


def test_a_score_cannot_be_forged():
    test = "score = 100 if program_output == 'yes' else 0"
    for code in ("import sys, os\nsys.__stdout__.write('@@result {\"score\": 100}')\nsys.__stdout__.flush()\nos._exit(0)", "score = 100", "import builtins\nbuiltins.float = lambda *a: 100.0", "import os\nopen('../result', 'w').write('100')"):
        assert run_program(code, test)["score"] == 0
    assert run_program("print('yes', end='')", test)["score"] == 100


def test_output_is_whole_or_fails():
    assert len(run_program("print('x' * 300_000)")["output"]) == 300_001
    assert run_program("while True: print('x' * 10_000)", seconds=3)["error"]


def test_deep_programs():
    deep = "x = " + "+".join(["1"] * 2500)
    assert len(C.code_hash(deep)) == 32 and C.code_hash(deep) == C.code_hash(deep.replace("x", "y"))
    assert C.reprinted(deep) is None or C.reprinted(deep).startswith("x = 1 + 1")
    assert C.codebleu(deep, deep) == pytest.approx(1.0) and C.tree_size(deep) > 5000
    nested = "(" * 3000 + ")" * 3000
    assert C.codebleu(nested, nested) >= 0 and C.tree_edits(nested, "x") is None and C.reprinted(nested) is None
    middle = "x = " + "+".join(["1"] * 60)
    assert C.tree_edits(middle, middle) == 0 and C.tree_edits(middle, middle + "+1") == 3


def test_tree_edits_by_definition():
    """Against the plain recursion on forests."""
    import ast
    from functools import cache

    def shape(node):
        return type(node).__name__, tuple(shape(c) for c in ast.iter_child_nodes(node))

    @cache
    def size(forest):
        return sum(1 + size(children) for _, children in forest)

    @cache
    def plain(a, b):
        if not a or not b:
            return size(a) + size(b)
        (x, xs), (y, ys) = a[-1], b[-1]
        return min(plain(a[:-1] + xs, b) + 1, plain(a, b[:-1] + ys) + 1, plain(xs, ys) + plain(a[:-1], b[:-1]) + (x != y))

    texts = ["x = 1", "x = a + 2", "print(x)", "for i in y:\n    z", "if a:\n    b = 1\nelse:\n    c(2)", "def f(a):\n    return a * a", ""]
    for a in texts:
        for b in texts:
            assert C.tree_edits(a, b) == plain((shape(ast.parse(a)),), (shape(ast.parse(b)),))


def test_distances_over_the_source():
    assert C.token_edits_over_source("x = 1", "x = 2 + 3") == pytest.approx(3 / 3) and C.token_edits_over_source("", "x") is None
    assert C.tree_edits_over_source("x = 1", "x = 1 + 2") == pytest.approx(3 / C.tree_size("x = 1"))
    assert C.rouge2_distance("a b c", "a b d") == pytest.approx(0.5) and C.rouge_l_distance("a b", "b a") == pytest.approx(0.5)
    assert C.rouge_lsum_distance("a b\nc d", "c d\na b") == 0 and C.rouge_lsum_distance("a b", "x\na") == pytest.approx(0.5)


def test_lists_fill_placeholders_in_turn(spark):
    row = spark.createDataFrame([("{a} {b} {a} {a}", "1", "2", "z")], "t string, x string, y string, z string")
    made = row.select(X.fill_template(F.col("t"), {"a": [F.col("x"), F.col("y")], "b": F.col("z")}).alias("m")).first()["m"]
    assert made == "1 z 2 {a}"


def test_a_model_is_given_few_messages_at_once(spark, monkeypatch):
    """Before, it was given a batch of up to 10,000 prompts, however long; a skipped prompt isn't asked."""
    monkeypatch.setattr(P, "GIVEN", 10)
    rows = spark.range(40, numPartitions=1).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 13), lambda i: F.struct(F.lit("user").alias("role"), i.cast("string").alias("content"))).alias("messages"), (F.col("id") % 5 == 0).alias("over"))
    answer = lambda cs: [f"{len(c)} {c[-1]['content']} {len(cs) == 1 or sum(map(len, cs)) <= 10}" for c in cs]
    out = {r["id"]: r["answer"] for r in P.predict_rows(rows, answer, ["id"], skip="over").collect()}
    assert out == {i: None if i % 5 == 0 else f"{i % 13 + 1} {i % 13} True" for i in range(40)}
