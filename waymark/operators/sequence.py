"""Window operators on trajectories: ordered attempts at a task, and turns of conversations.

``steps`` hold one row for each submission, keyed by trajectory columns with an integer
``seq`` from 1; ``turns`` one row for each message with an integer position.  All windows
of one trajectory share its partitioning, so a chain of them needs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .pairing import drawn_pairs

Keys = Sequence[str]


def _over(keys: Keys, order: str = "seq"):
    return Window.partitionBy(*keys).orderBy(order)


def number_steps(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """df with ``seq``, the 1-based place of a row in its trajectory."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def without_repeats(steps: DataFrame, keys: Keys, code_hash: str = "code_hash", empty_hash: str = "") -> DataFrame:
    """Drop a step whose hash equals the one before it (before the first: the empty program's),
    and number the others anew.  A dropped step equals the last kept one, so looking at the
    row before is enough."""
    before = F.lag(code_hash, 1, empty_hash).over(_over(keys))
    kept = steps.withColumn("_waymark_before", before).where(~F.col(code_hash).eqNullSafe(F.col("_waymark_before"))).drop("_waymark_before")
    return kept.withColumn("seq", F.row_number().over(_over(keys)))


def until_success(steps: DataFrame, keys: Keys, success: Column) -> DataFrame:
    """Steps up to and including the first success."""
    won = F.sum(F.coalesce(success, F.lit(False)).cast("int")).over(_over(keys).rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_waymark_won", F.coalesce(won, F.lit(0))).where("_waymark_won = 0").drop("_waymark_won")


def without_mismatch(steps: DataFrame, keys: Keys, recorded: str, regraded: str) -> DataFrame:
    """Drop whole trajectories in which a known recorded grade differs from the new one."""
    off = F.coalesce(~F.isnan(F.col(recorded).cast("double")) & (F.col(recorded) != F.col(regraded)), F.lit(False))
    return steps.withColumn("_waymark_off", F.max(off.cast("int")).over(Window.partitionBy(*keys))).where("_waymark_off = 0").drop("_waymark_off")


def grade_changed(keys: Keys, grade: str = "grade") -> Column:
    """Whether the two grades before a step differ; false before there are two."""
    w = _over(keys)
    return F.coalesce(F.lag(grade, 1).over(w) != F.lag(grade, 2).over(w), F.lit(False))


def to_turns(steps: DataFrame, keys: Keys, system: Column, problem: Column, code: str = "code", feedback: str = "feedback") -> DataFrame:
    """Conversation of each trajectory in long form: system, problem, then each submission
    and its feedback.  Each step makes its own rows, the first the opening as well."""
    opening = F.array(F.struct(F.lit(0).alias("pos"), F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit(1).alias("pos"), F.lit("user").alias("role"), problem.alias("content")))
    pair = F.array(
        F.struct((2 * F.col("seq")).cast("int").alias("pos"), F.lit("assistant").alias("role"), F.col(code).alias("content")),
        F.struct((2 * F.col("seq") + 1).cast("int").alias("pos"), F.lit("user").alias("role"), F.col(feedback).alias("content")),
    )
    rows = steps.select(*keys, F.explode(F.when(F.col("seq") == 1, F.concat(opening, pair)).otherwise(pair)).alias("m"))
    return rows.select(*keys, "m.pos", "m.role", "m.content")


def to_messages(turns: DataFrame, keys: Keys, pos: str = "pos", role: str = "role", content: str = "content") -> DataFrame:
    """(keys, messages array): for sinks only; a row holds a whole conversation."""
    return turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("messages"))


def with_feedback(turns: DataFrame, keys: Keys, pos: str, role: str, content: str) -> DataFrame:
    """Assistant turns with the content of the turn that follows, null at the end."""
    return turns.withColumn("feedback", F.lead(content).over(_over(keys, pos))).where(F.col(role) == "assistant")


def with_previous(steps: DataFrame, keys: Keys, code: str = "code") -> DataFrame:
    return steps.withColumn("previous_code", F.lag(code).over(_over(keys)))


def next_pairs(steps: DataFrame, keys: Keys, code: str = "code", code_hash: str = "code_hash", first: int = 2, ahead: int = 2) -> DataFrame:
    """Chosen: a step from the second on; rejected: the one two later, of another hash."""
    w = _over(keys)
    ends = steps.withColumn("rejected_seq", F.lead("seq", ahead).over(w)).withColumn("rejected", F.lead(code, ahead).over(w)).withColumn("_waymark_hash", F.lead(code_hash, ahead).over(w))
    return ends.where((F.col("seq") >= first) & F.col("rejected_seq").isNotNull() & (F.col(code_hash) != F.col("_waymark_hash"))).drop("_waymark_hash")


def grade_pairs(steps: DataFrame, keys: Keys, grade: str = "grade") -> DataFrame:
    """Rejected: the first later step of another known grade.

    Among steps of known grade that is where the next run of equal grades begins, so two
    windows of one partitioning find it and no step meets another.
    """
    known = steps.where(F.col(grade).isNotNull()).select(*keys, "seq", F.when(F.lag(grade).over(_over(keys)) != F.col(grade), F.col("seq")).alias("_waymark_start"))
    later = Window.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ends = known.withColumn("rejected_seq", F.last("_waymark_start", ignorenulls=True).over(later))
    return ends.where(F.col("rejected_seq").isNotNull()).drop("_waymark_start")


def temporal_pairs(steps: DataFrame, keys: Keys, code_hash: str = "code_hash", distance: int = 3, seed: str = "") -> DataFrame:
    """Rejected: one of the steps at least ``distance`` later with another hash, all alike likely,
    drawn by each step's own hash; a step may be rejected many times."""
    return drawn_pairs(steps.withColumn("grade", F.lit(None)), keys, "temporal", code_hash=code_hash, distance=distance, replace=True, seed=seed)


def greedy_pairs(steps: DataFrame, keys: Keys, kind: str = "grade", grade: str = "grade", code_hash: str = "code_hash", distance: int = 3) -> DataFrame:
    """(keys, seq, rejected_seq) with each step rejected at most once, anchors in ascending order.

    'grade' takes the first later step of another known grade that isn't used yet; if the
    hashes agree the anchor is given up and the step stays free.  'temporal' takes the first
    unused step at least ``distance`` later with another hash.
    """
    return drawn_pairs(steps, keys, kind, grade, code_hash, distance, drawn=False)


def random_later(steps: DataFrame, keys: Keys, order: Column, name: str = "pick") -> DataFrame:
    """Each step with a later one, that of the least ``order``; steps without later ones go.

    A running minimum from the end: all steps that share a choice share its draw.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.struct(order.alias("order"), F.col("seq").alias("seq"))).over(later)
    return steps.withColumn(name, best["seq"]).where(F.col(name).isNotNull())


def with_remaining(steps: DataFrame, keys: Keys, code: str = "code", grade: str = "grade") -> DataFrame:
    """Each step with the codes and grades of all later ones."""
    rest = F.collect_list(F.struct(F.col(code).alias("code"), F.col(grade).alias("grade"))).over(_over(keys).rowsBetween(1, Window.unboundedFollowing))
    return steps.withColumn("_waymark_rest", rest).withColumn("remaining_codes", F.col("_waymark_rest.code")).withColumn("remaining_grades", F.col("_waymark_rest.grade")).drop("_waymark_rest")


def prefix(messages: Column, length: Column) -> Column:
    """The first messages of a conversation."""
    return F.slice(messages, F.lit(1), F.greatest(length, F.lit(0)))


def expansion_targets(turns: DataFrame, keys: Keys, pos: str, role: str, content: str, after: int = 2) -> DataFrame:
    """Assistant turns after a position that hold a fenced block: one training target each."""
    return turns.where(is_target(pos, role, content, after))


def is_target(pos: str, role: str, content: str, after: int = 2) -> Column:
    return (F.col(role) == "assistant") & (F.col(pos) > after) & F.col(content).rlike("(?s)```.*?```")


def truncate_left(turns: DataFrame, keys: Keys, budget: int, tokens: Column, pos: str = "pos", role: str = "role", counted: Observation | None = None) -> DataFrame:
    """Keep the opening (system and first user turn) and as many last turns as fit.

    The kept rest begins with an assistant turn.  Tokens add up over messages, so the
    cheapest start is a running sum from the end.  Adds kept_from (the first kept position
    after the opening, null if none), truncated and fits (false: the opening alone is over
    the budget, no turn is returned).  ``counted`` takes n, n_truncated and n_rejected
    conversations while the rows are written, of the same scan.
    """
    w = Window.partitionBy(*keys)
    up, down = w.orderBy(F.col(pos)), w.orderBy(F.desc(pos))
    rows = turns.withColumn("_waymark_tok", tokens).withColumn("_waymark_first_user", F.min(F.when(F.col(role) == "user", F.col(pos))).over(w)).withColumn("_waymark_place", F.row_number().over(up))
    leads = F.min(F.when((F.col("_waymark_place") == 1) & (F.col(role) == "system"), F.col(pos))).over(w)
    last = F.coalesce(F.col("_waymark_first_user"), leads)
    rows = rows.withColumn("_waymark_open", F.coalesce(F.col(pos) <= last, F.lit(False)) & ((F.col(role) == "user") | ((F.col(role) == "system") & (F.col("_waymark_place") == 1)) | F.col("_waymark_first_user").isNotNull()))
    rows = rows.withColumn("_waymark_opening", F.sum(F.when(F.col("_waymark_open"), F.col("_waymark_tok")).otherwise(0)).over(w)).withColumn("_waymark_all", F.sum("_waymark_tok").over(w)).withColumn("_waymark_suffix", F.sum("_waymark_tok").over(down))
    start = F.min(F.when(~F.col("_waymark_open") & (F.col(role) == "assistant") & (F.col("_waymark_opening") + F.col("_waymark_suffix") <= budget), F.col(pos))).over(w)
    whole = F.col("_waymark_all") <= budget
    rows = rows.withColumn("kept_from", F.when(~whole, start)).withColumn("truncated", ~whole).withColumn("fits", whole | (F.col("_waymark_opening") <= budget))
    if counted is not None:
        of = lambda c: F.coalesce(F.sum(F.when(F.col("_waymark_place") == 1, c.cast("long"))), F.lit(0))
        rows = rows.observe(counted, of(F.lit(1)).alias("n"), of(F.col("truncated") & F.col("fits")).alias("n_truncated"), of(~F.col("fits")).alias("n_rejected"))
    kept = F.col("fits") & (~F.col("truncated") | F.col("_waymark_open") | F.coalesce(F.col(pos) >= F.col("kept_from"), F.lit(False)))
    return rows.where(kept).drop("_waymark_tok", "_waymark_first_user", "_waymark_place", "_waymark_open", "_waymark_opening", "_waymark_all", "_waymark_suffix")


def truncated_targets(turns: DataFrame, keys: Keys, budget: int, tokens: Column, target: Column, pos: str = "pos", role: str = "role") -> DataFrame:
    """(keys, target, kept_from, n_messages, truncated) for each turn that ``target`` picks: what
    ``truncate_left`` keeps of the turns up to it.  Targets whose opening alone is over the budget go,
    and those of which nothing is kept.

    Linear in turns.  With running sums S a start p fits target t if opening + S(t) - S(p - 1)
    is within the budget, so the first start is the least S(p - 1) that isn't below opening + S(t) - budget:
    starts and targets are put in one order by these numbers, and each target looks at
    the start that follows it there.  All windows share the keys' partitioning.
    """
    w = Window.partitionBy(*keys)
    up_to = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select(*keys, F.col(pos).alias("_p"), F.col(role).alias("_role"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_tok"), F.coalesce(target, F.lit(False)).alias("_target"))
    rows = rows.withColumn("_sum", F.sum("_tok").over(up_to)).withColumn("_place", F.row_number().over(w.orderBy("_p")))
    rows = rows.withColumn("_user", F.min(F.when(F.col("_role") == "user", F.col("_p"))).over(up_to))  # of the turns so far
    opening = F.max(F.when(F.col("_p") == F.col("_user"), F.struct("_sum", "_place"))).over(up_to)
    leads = F.max(F.when((F.col("_place") == 1) & (F.col("_role") == "system"), F.struct(F.col("_tok").alias("_sum"), F.col("_place")))).over(up_to)
    rows = rows.withColumn("_open", F.coalesce(opening, leads, F.struct(F.lit(0).cast("long").alias("_sum"), F.lit(0).alias("_place"))))
    rows = rows.withColumn("_late", F.col("_user").isNotNull()).withColumn("_need", F.col("_open._sum") + F.col("_sum") - budget)
    start = F.when((F.col("_role") == "assistant") & (F.col("_place") > F.col("_open._place")), F.struct(F.lit(1).alias("kind"), (F.col("_sum") - F.col("_tok")).alias("at")))
    wanted = F.when(F.col("_target"), F.struct(F.lit(0).alias("kind"), F.col("_need").alias("at")))
    marks = rows.withColumn("_mark", F.explode(F.filter(F.array(wanted, start), lambda x: x.isNotNull())))
    ahead = Window.partitionBy(*keys, "_late").orderBy(F.desc("_mark.at"), F.desc("_mark.kind"), F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(F.when(F.col("_mark.kind") == 1, F.struct("_p", "_place")), ignorenulls=True).over(ahead)
    found = marks.withColumn("_from", following).where(F.col("_mark.kind") == 0)
    whole, at = F.col("_sum") <= budget, F.when(F.col("_from._p") <= F.col("_p"), F.col("_from"))
    found = found.withColumn("_at", F.when(~whole, at)).where(whole | (F.col("_open._sum") <= budget))
    n = F.when(whole, F.col("_place")).otherwise(F.col("_open._place") + F.coalesce(F.col("_place") - F.col("_at._place") + 1, F.lit(0)))
    return found.select(*keys, F.col("_p").alias("target"), F.col("_at._p").alias("kept_from"), n.cast("long").alias("n_messages"), (~whole).alias("truncated")).where("n_messages > 0")


def truncate_pairs(turns: DataFrame, keys: Keys, budget: int, tokens: Column, pos: str = "pos", role: str = "role", fixed: int = 2) -> DataFrame:
    """Keep the first ``fixed`` turns and the last one; drop oldest (assistant, user) pairs
    between them until the rest fits, or only these are left.

    Dropping takes the oldest turn and, if a user turn follows, that too, so each drop ends
    before an assistant turn or before two turns in a row that aren't user turns.
    """
    w = Window.partitionBy(*keys)
    up, down = w.orderBy(pos), w.orderBy(F.desc(pos))
    rows = turns.withColumn("_waymark_tok", tokens).withColumn("_waymark_place", F.row_number().over(up)).withColumn("_waymark_n", F.count("*").over(w)).withColumn("_waymark_suffix", F.sum("_waymark_tok").over(down))
    rows = rows.withColumn("_waymark_head", F.sum(F.when(F.col("_waymark_place") <= fixed, F.col("_waymark_tok")).otherwise(0)).over(w))
    begins = (F.col("_waymark_place") == fixed + 1) | (F.col(role) != "user")
    able = (F.col("_waymark_place") > fixed) & ((F.col("_waymark_place") == F.col("_waymark_n")) | (begins & (F.col("_waymark_head") + F.col("_waymark_suffix") <= budget)))
    start = F.min(F.when(able, F.col("_waymark_place"))).over(w)
    return rows.withColumn("_waymark_start", start).where((F.col("_waymark_place") <= fixed) | (F.col("_waymark_place") >= F.col("_waymark_start"))).drop("_waymark_tok", "_waymark_place", "_waymark_n", "_waymark_suffix", "_waymark_head", "_waymark_start")


def cleaned(content: Column) -> Column:
    """Without thoughts, and of the rest only the content of the last fenced block (all if there is none)."""
    bare = F.regexp_replace(content, "(?s)<think>.*?</think>", "")
    return F.coalesce(F.try_element_at(F.regexp_extract_all(bare, F.lit("(?s)```[a-zA-Z]*\n(.*?)```"), F.lit(1)), F.lit(-1)), bare)


def cleaned_prompt(turns: DataFrame, keys: Keys, pos: str, role: str, content: str) -> DataFrame:
    """Assistant turns before the last turn lose thoughts and keep only the content of their
    last fenced block (the rest unchanged if there is none)."""
    last = F.max(pos).over(Window.partitionBy(*keys))
    clean = F.when((F.col(role) == "assistant") & (F.col(pos) < F.col("_waymark_last")), cleaned(F.col(content))).otherwise(F.col(content))
    return turns.withColumn("_waymark_last", last).withColumn(content, clean).drop("_waymark_last")


def rollout_grid(lengths: DataFrame, length: str, start: int = 2, steps: int = 5) -> DataFrame:
    """A row for each start k = start..n and step 1..min(steps, n - k + 1)."""
    grid = lengths.where(F.col(length) >= start).withColumn("k", F.explode(F.sequence(F.lit(start), F.col(length).cast("int"))))
    return grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(steps), (F.col(length) - F.col("k") + 1).cast("int")))))


def align_truth(grid: DataFrame, steps: DataFrame, keys: Keys) -> DataFrame:
    """Step s of the task that begins at k meets submission k + s - 1."""
    return grid.withColumn("seq", F.col("k") + F.col("step") - 1).join(steps, [*keys, "seq"])


def recording_mode(rows: DataFrame, keys: Keys, terminal: Column, error: Column | None = None) -> DataFrame:
    """Adds mode: 'generation' up to the step that ends a task, 'recording' after it; an
    error step itself is 'recording'."""
    failed = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    done = F.min(F.when(F.coalesce(terminal, F.lit(False)) | failed, F.col("step"))).over(Window.partitionBy(*keys, "k"))
    live = (F.col("_waymark_done").isNull() | (F.col("step") <= F.col("_waymark_done"))) & ~failed
    return rows.withColumn("_waymark_done", done).withColumn("mode", F.when(live, "generation").otherwise("recording")).drop("_waymark_done")


def solved(rows: DataFrame, keys: Keys, success: str) -> DataFrame:
    """(keys, k, solved_last, solved_any) of each task."""
    return rows.groupBy(*keys, "k").agg(F.max_by(success, "step").alias("solved_last"), F.max(success).alias("solved_any"))
