"""Rollouts: a model continues each trajectory step by step, next to what really happened.

The prompt of a step holds the answers of the steps before and the feedback on them, so
rounds are sequential; all tasks of a round are one DataFrame.  A model is a function from
a list of conversations to a list of answers; it runs inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable
from ..functions import code as C
from ..functions import text as X
from ..operators import sequence as W
from ..workers import ship

Predict = Callable[[list[list[dict]]], list[str]]
Grade = Callable[[DataFrame], DataFrame]


#: Messages that a model is given at once, more if one prompt has more: a task's memory doesn't grow with its rows.
GIVEN = 1 << 16


def predict_rows(prompts: DataFrame, predict: Predict, keys: Sequence[str], messages: str = "messages", carry: Sequence[str] = (), skip: str | None = None) -> DataFrame:
    """keys and carried columns with ``answer``; row order plays no part.  Rows whose ``skip`` is true
    aren't asked, their answer is null."""
    ship(prompts.sparkSession)
    kept = [*keys, *carry]
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in kept) + ", answer string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, skipped = b.column(len(kept)), b.column(len(kept) + 1).to_pylist()
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            first = 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + GIVEN, "right")) - 1)
                roles, contents = lists.slice(first, last - first).flatten().flatten()
                said = [{"role": r, "content": c} for r, c in zip(roles.to_pylist(), contents.to_pylist())]
                asked = [i for i in range(first, last) if not skipped[i]]
                answers = iter(predict([said[ends[i] - ends[first] : ends[i + 1] - ends[first]] for i in asked]) if asked else [])
                made = [None if skipped[i] else next(answers) for i in range(first, last)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, last - first) for k in range(len(kept))), pa.array(made, pa.string())], [*kept, "answer"])
                first = last

    none = F.coalesce(F.col(skip), F.lit(False)) if skip else F.lit(False)
    given = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return prompts.select(*kept, given.alias("_waymark_given"), none.alias("_waymark_skip")).mapInArrow(run, schema)


def by_column(grade: Callable[[Column], Column]) -> Grade:
    """A grade that is an expression of the code."""
    return lambda rows: rows.withColumn("grade", grade(F.col("code")).cast("double"))


def _prompts(context: DataFrame, task: list[str], budget: int | None, tokens: Callable[[Column], Column] | None) -> DataFrame:
    """(task, messages, history, over_budget): prompts, and all answers as they were given.

    ``clean`` is a turn's content where it isn't the last one; it was made of each turn before a task got its copy.
    """
    row = F.struct("pos", "role", "content", "clean")
    whole = context.groupBy(*task).agg(F.array_sort(F.collect_list(row)).alias("m"))
    shown = F.transform("m", lambda x, i: F.struct(x["role"].alias("role"), F.when(i < F.size("m") - 1, x["clean"]).otherwise(x["content"]).alias("content")))
    history = whole.select(*task, F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x["content"]).alias("history"), shown.alias("messages"))
    if budget is None:
        return history.withColumn("over_budget", F.lit(False))
    last = F.max("pos").over(Window.partitionBy(*task))
    turns = context.withColumn("_waymark_last", last).select(*task, "pos", "role", F.when(F.col("pos") < F.col("_waymark_last"), F.col("clean")).otherwise(F.col("content")).alias("content"))
    cut = W.truncate_pairs(turns, task, budget, tokens(F.col("content")))
    short = cut.groupBy(*task).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"), (F.sum(tokens(F.col("content"))) >= budget).alias("over_budget"))
    short = short.select(*task, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), "over_budget")
    return history.drop("messages").join(short, task)


def rollout(steps: DataFrame, turns: DataFrame, keys: Sequence[str], predict: Predict, grade: Grade, rounds: int = 5, start: int = 2, save: Callable[[DataFrame, int], DataFrame] | None = None, clean: bool = True, budget: int | None = None, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """A result row for each task and step.

    ``steps`` have seq, code and grade; ``turns`` pos, role and content with submission s at
    pos 2 s and its feedback at 2 s + 1.  An answer takes the place of the submission it stands
    for, and the feedback on it follows as a user's turn.  Answers before the last turn are
    reduced to their code (``clean``); with a ``budget`` the oldest pairs go until a prompt
    fits, and a task whose least prompt doesn't fit ends with ``over_budget`` set.

    ``grade`` gets rows (keys, k, step, code) that have code and returns them with ``grade`` and,
    if it likes, ``feedback`` (see ``by_column`` and ``grading.grader``); an answer that is a
    diff is applied to the conversation's program first.  ``save`` stores a round and returns it
    as stored (default: a reliable checkpoint); a lost executor costs one round at most.  A
    task ends after the step that reaches 100, gives up or yields no code; later steps are
    recorded with empty code.
    """
    if budget is not None and tokens is None:
        raise ValueError("a budget needs a way to count tokens")
    keep = save or (lambda df, step: reliable(df))
    lengths = steps.groupBy(*keys).agg(F.max("seq").alias("n"))
    grid = W.align_truth(W.rollout_grid(lengths, "n", start, rounds), steps.select(*keys, "seq", F.col("code").alias("student_code"), F.col("grade").alias("student_grade")), keys)
    task = [*keys, "k"]
    turns = turns.select(*keys, F.col("pos").cast("int").alias("pos"), "role", "content")
    shown = lambda rows: rows.withColumn("clean", F.when(F.col("role") == "assistant", W.cleaned(F.col("content"))).otherwise(F.col("content")) if clean else F.col("content"))
    turns = shown(turns)
    said: DataFrame | None = None
    for step in range(1, rounds + 1):
        now = grid.where(F.col("step") == step)
        if said is not None:
            now = now.join(said.where("ended").select(*task).distinct(), task, "left_anti")
        context = now.select(*task).join(turns, list(keys)).where(F.col("pos") < 2 * F.col("k")).select(*task, "pos", "role", "content", "clean")
        if said is not None:
            at = (2 * F.col("seq")).cast("int")
            pair = F.array(F.struct(at.alias("pos"), F.lit("assistant").alias("role"), F.col("answer").alias("content")), F.struct((at + 1).alias("pos"), F.lit("user").alias("role"), F.col("feedback").alias("content")))
            own = shown(said.select(*task, F.explode(pair).alias("m")).select(*task, "m.*"))
            context = context.unionByName(own.join(now.select(*task), task, "left_semi"))
        # checked and answered once a round; a prompt that doesn't fit isn't asked
        prompts = _prompts(context, task, budget, tokens)
        asked = predict_rows(prompts, predict, task, carry=["history", "over_budget"], skip="over_budget")
        rebuilt = F.when(F.col("answer").rlike(X.DIFF_FENCE), F.concat("history", F.array("answer")))
        asked = asked.withColumn("code", X.model_code(F.col("answer"), C.udf("reconstruct")(rebuilt))).drop("history")
        made = keep(now.join(asked, task, "left").select(*task, "step", "seq", "answer", "code", "over_budget"), 2 * step - 1)
        graded = grade(made.where(F.col("code").isNotNull()).select(*task, "step", "code"))
        if "feedback" not in graded.columns:
            graded = graded.withColumn("feedback", F.concat(F.lit("Unit Test Returned: "), F.coalesce(F.col("grade").cast("string"), F.lit("0"))))
        made = made.join(graded.select(*task, "grade", F.col("feedback").alias("feedback")), task, "left")
        failed = F.col("code").isNull()
        made = made.withColumn("ended", failed | F.coalesce(F.col("grade") >= 100, F.lit(False)) | F.coalesce(X.gives_up(F.col("code")), F.lit(False)))
        made = keep(made.select(*task, "step", "seq", "answer", "code", "grade", "feedback", "ended", "over_budget"), 2 * step)
        said = made if said is None else said.unionByName(made)
    rows = grid.join(said.select(*task, "step", "answer", F.col("code").alias("made"), "grade", "ended", "over_budget"), [*task, "step"], "left")
    error = F.col("ended") & F.col("made").isNull()
    rows = W.recording_mode(rows, keys, F.col("ended") & F.col("made").isNotNull(), error)
    rows = rows.withColumns({"code": F.coalesce("made", F.lit("")), "successful": F.coalesce(F.col("grade") >= 100, F.lit(False)), "over_budget": F.coalesce("over_budget", F.lit(False))})
    return rows.drop("made", "ended")
