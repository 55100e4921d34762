"""Windows over trajectories and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import folder, remove
from ..operators import sequence as W
from ..operators.pairing import drawn_pairs
from ..plans import datasets as D
from .fixtures import FENCED, KEYS, ROLLOUT, STEPS, TURNS, fenced, rollout_rows, steps, turns
from .registry import query

_P = "PARTITION BY user_id, problem_id ORDER BY seq"
_FRESH = f"""{STEPS}, fresh AS (SELECT * EXCLUDE (seq), row_number() OVER ({_P})::INTEGER AS seq FROM (SELECT *, lag(code, 1, '') OVER ({_P}) AS before FROM steps) WHERE code <> before)"""
_CUT = f"{_FRESH}, cut AS (SELECT * FROM (SELECT *, coalesce(sum((grade >= 90)::INT) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM fresh) WHERE won = 0)"


@query(f"WITH {STEPS} SELECT user_id, problem_id, event_id, seq FROM steps")
def chronological(spark, sf_dir):
    return steps(spark, sf_dir).select(*KEYS, "event_id", "seq")


@query(f"WITH {_FRESH} SELECT user_id, problem_id, seq, code FROM fresh")
def dedup_consecutive(spark, sf_dir):
    return W.without_repeats(steps(spark, sf_dir), KEYS, "code_hash").select(*KEYS, "seq", "code")


@query(f"WITH {_CUT} SELECT user_id, problem_id, seq, grade FROM cut")
def stop_at_success(spark, sf_dir):
    return W.until_success(W.without_repeats(steps(spark, sf_dir), KEYS, "code_hash"), KEYS, F.col("grade") >= 90).select(*KEYS, "seq", "grade")


@query(f"WITH {_CUT}, v AS (SELECT *, max((event_id % 97 = 0)::INT) OVER (PARTITION BY user_id, problem_id) AS off FROM cut) SELECT user_id, problem_id, seq FROM v WHERE off = 0")
def void_mismatch(spark, sf_dir):
    s = W.until_success(W.without_repeats(steps(spark, sf_dir), KEYS, "code_hash"), KEYS, F.col("grade") >= 90)
    s = s.withColumn("again", F.when(F.col("event_id") % 97 == 0, F.col("grade") + 1).otherwise(F.col("grade")))
    return W.without_mismatch(s, KEYS, "grade", "again").select(*KEYS, "seq")


@query(f"WITH {_FRESH} SELECT user_id, problem_id, seq AS submission_number FROM fresh")
def submission_number(spark, sf_dir):
    return W.without_repeats(steps(spark, sf_dir), KEYS, "code_hash").select(*KEYS, F.col("seq").alias("submission_number"))


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq, coalesce(lag(grade, 1) OVER ({_P}) <> lag(grade, 2) OVER ({_P}), false) AS changed FROM steps")
def grade_change_flag(spark, sf_dir):
    return steps(spark, sf_dir).select(*KEYS, "seq", W.grade_changed(KEYS).alias("changed"))


@query(f"""WITH {STEPS} SELECT user_id, problem_id, 0::INTEGER AS pos, 'system' AS role, 'You learn' AS content FROM steps WHERE seq = 1 UNION ALL SELECT user_id, problem_id, 1, 'user', problem_id FROM steps WHERE seq = 1
UNION ALL SELECT user_id, problem_id, 2 * seq, 'assistant', code FROM steps UNION ALL SELECT user_id, problem_id, 2 * seq + 1, 'user', 'grade ' || grade::BIGINT::VARCHAR FROM steps""")
def interleave_turns(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("feedback", F.concat(F.lit("grade "), F.col("grade").cast("long").cast("string")))
    return W.to_turns(s, KEYS, F.lit("You learn"), F.col("problem_id"))


@query(f"WITH {STEPS} SELECT user_id, problem_id, count(*)::BIGINT * 2 + 2 AS n_messages, max_by(code, seq) AS last_code FROM steps GROUP BY ALL")
def conversation_arrays(spark, sf_dir):
    s = steps(spark, sf_dir).withColumn("feedback", F.lit("ok"))
    rows = W.to_messages(W.to_turns(s, KEYS, F.lit("You learn"), F.col("problem_id")), KEYS)
    return rows.select(*KEYS, F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -2)["content"].alias("last_code"))


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq, code, lag(code) OVER ({_P}) AS previous_code FROM steps")
def previous_submission(spark, sf_dir):
    return W.with_previous(steps(spark, sf_dir), KEYS).select(*KEYS, "seq", "code", "previous_code")


@query(f"WITH {TURNS} SELECT conv_id, pos, feedback FROM (SELECT *, lead(content) OVER (PARTITION BY conv_id ORDER BY pos) AS feedback FROM turns) WHERE role = 'assistant'")
def feedback_lead(spark, sf_dir):
    return W.with_feedback(turns(spark, sf_dir), ["conv_id"], "pos", "role", "content").select("conv_id", "pos", "feedback")


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq, rejected_seq FROM (SELECT *, lead(seq, 2) OVER ({_P}) AS rejected_seq, lead(code, 2) OVER ({_P}) AS other FROM steps) WHERE seq >= 2 AND other <> code")
def pairs_next(spark, sf_dir):
    return W.next_pairs(steps(spark, sf_dir), KEYS).select(*KEYS, "seq", "rejected_seq")


@query(f"WITH {STEPS} SELECT c.user_id, c.problem_id, c.seq, min(r.seq) AS rejected_seq FROM steps c JOIN steps r ON c.user_id = r.user_id AND c.problem_id = r.problem_id AND r.seq > c.seq AND r.grade <> c.grade GROUP BY ALL")
def pairs_grade_first(spark, sf_dir):
    return W.grade_pairs(steps(spark, sf_dir), KEYS)


#: The number that a step draws, and its place in the order of turns.
_DRAW = "('0x' || substr(md5('draw|s|' || c.user_id::VARCHAR || '|' || c.problem_id || '|' || c.seq::VARCHAR), 1, 8))::BIGINT"
_TURN = "md5('turn|s|' || c.user_id::VARCHAR || '|' || c.problem_id || '|' || c.seq::VARCHAR)"


@query(f"""WITH {STEPS} SELECT c.user_id, c.problem_id, c.seq, list(r.seq ORDER BY r.seq)[1 + any_value({_DRAW}) % count(*)] AS rejected_seq
FROM steps c JOIN steps r ON c.user_id = r.user_id AND c.problem_id = r.problem_id AND r.seq >= c.seq + 3 AND r.code_hash <> c.code_hash GROUP BY ALL""")
def pairs_temporal_relaxed(spark, sf_dir):
    return W.temporal_pairs(steps(spark, sf_dir), KEYS, seed="s")


@query(f"""WITH RECURSIVE {STEPS}, turns AS (SELECT c.*, {_DRAW} AS draw, row_number() OVER (PARTITION BY user_id, problem_id ORDER BY {_TURN}, seq) AS turn FROM steps c), walk AS (
  SELECT DISTINCT user_id, problem_id, 0::BIGINT AS turn, NULL::INTEGER AS seq, []::INTEGER[] AS used, NULL::INTEGER AS rejected FROM steps
  UNION ALL
  SELECT w.user_id, w.problem_id, c.turn, c.seq, CASE WHEN len(p.free) = 0 THEN w.used ELSE list_append(w.used, p.free[1 + c.draw % len(p.free)]) END, CASE WHEN len(p.free) > 0 THEN p.free[1 + c.draw % len(p.free)] END
  FROM walk w JOIN turns c ON c.user_id = w.user_id AND c.problem_id = w.problem_id AND c.turn = w.turn + 1
  LEFT JOIN LATERAL (SELECT coalesce(list(r.seq ORDER BY r.seq), []) AS free FROM steps r WHERE r.user_id = c.user_id AND r.problem_id = c.problem_id AND r.seq >= c.seq + 3 AND r.code_hash <> c.code_hash AND NOT list_contains(w.used, r.seq)) p ON true
) SELECT user_id, problem_id, seq, rejected AS rejected_seq FROM walk WHERE rejected IS NOT NULL""")
def pairs_temporal_drawn(spark, sf_dir):
    """Anchors in random order, each with a random later step that no other has taken."""
    return drawn_pairs(steps(spark, sf_dir), KEYS, "temporal", seed="s")


_GREEDY = STEPS + """, walk AS (
  SELECT user_id, problem_id, 0 AS seq, []::INTEGER[] AS used, NULL::INTEGER AS rejected FROM steps WHERE seq = 1
  UNION ALL
  SELECT w.user_id, w.problem_id, c.seq, CASE WHEN p.rejected IS NULL THEN w.used ELSE list_append(w.used, p.rejected) END, p.rejected
  FROM walk w JOIN steps c ON c.user_id = w.user_id AND c.problem_id = w.problem_id AND c.seq = w.seq + 1
  LEFT JOIN LATERAL (%s) p ON true
) SELECT user_id, problem_id, seq, rejected AS rejected_seq FROM walk WHERE rejected IS NOT NULL"""
_GRADE = "SELECT CASE WHEN arg_min(r.code_hash, r.seq) <> c.code_hash THEN min(r.seq) END AS rejected FROM steps r WHERE r.user_id = c.user_id AND r.problem_id = c.problem_id AND r.seq > c.seq AND r.grade <> c.grade AND NOT list_contains(w.used, r.seq)"
_TEMPORAL = "SELECT min(r.seq) AS rejected FROM steps r WHERE r.user_id = c.user_id AND r.problem_id = c.problem_id AND r.seq >= c.seq + 3 AND r.code_hash <> c.code_hash AND NOT list_contains(w.used, r.seq)"


@query(f"WITH RECURSIVE {_GREEDY % _GRADE}")
def pairs_grade_greedy(spark, sf_dir):
    return W.greedy_pairs(steps(spark, sf_dir), KEYS, "grade")


@query(f"WITH RECURSIVE {_GREEDY % _TEMPORAL}")
def pairs_temporal_greedy(spark, sf_dir):
    return W.greedy_pairs(steps(spark, sf_dir), KEYS, "temporal")


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq, coalesce(list(code) OVER w, []) AS remaining_codes, coalesce(list(grade) OVER w, []) AS remaining_grades FROM steps WINDOW w AS ({_P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def remaining_trajectory(spark, sf_dir):
    return W.with_remaining(steps(spark, sf_dir), KEYS).select(*KEYS, "seq", "remaining_codes", "remaining_grades")


@query(f"WITH {TURNS} SELECT t.conv_id, t.pos, count(p.pos)::BIGINT AS n_before, coalesce(sum(length(p.content)), 0)::BIGINT AS chars_before FROM turns t LEFT JOIN turns p ON t.conv_id = p.conv_id AND p.pos < t.pos GROUP BY ALL")
def prefix_context(spark, sf_dir):
    t = turns(spark, sf_dir)
    both = t.join(W.to_messages(t, ["conv_id"]), "conv_id").withColumn("before", W.prefix(F.col("messages"), F.col("pos")))
    return both.select("conv_id", "pos", F.size("before").cast("long").alias("n_before"), F.aggregate("before", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("chars_before"))


@query(f"WITH {TURNS} SELECT conv_id, pos FROM turns WHERE role = 'assistant' AND pos > 2")
def sft_expand(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("content", fenced(F.col("content")))
    return W.expansion_targets(t, ["conv_id"], "pos", "role", "content").select("conv_id", "pos")


_TRUNCATE = f"""{TURNS}, base AS (SELECT *, length(content) AS tok, min(pos) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS fu FROM turns),
opened AS (SELECT *, pos <= fu AS opening, sum(tok) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS suffix, sum(tok) OVER (PARTITION BY conv_id) AS total FROM base),
pre AS (SELECT *, sum(tok) FILTER (opening) OVER (PARTITION BY conv_id) AS head FROM opened),
placed AS (SELECT *, total > 1500 AS truncated, CASE WHEN total > 1500 THEN min(pos) FILTER (NOT opening AND role = 'assistant' AND head + suffix <= 1500) OVER (PARTITION BY conv_id) END AS kept_from FROM pre),
kept AS (SELECT * FROM placed WHERE (total <= 1500 OR head <= 1500) AND (NOT truncated OR opening OR coalesce(pos >= kept_from, false)))"""


@query(f"WITH {_TRUNCATE} SELECT conv_id, pos, kept_from, truncated FROM kept")
def left_truncate(spark, sf_dir):
    return W.truncate_left(turns(spark, sf_dir), ["conv_id"], 1500, F.length("content")).select("conv_id", "pos", "kept_from", "truncated")


@query(f"WITH {_TRUNCATE}, c AS (SELECT conv_id, max(truncated::INT) AS cut FROM kept GROUP BY 1), a AS (SELECT DISTINCT conv_id FROM turns) SELECT count(*)::BIGINT AS n, sum(coalesce(cut, 0))::BIGINT AS n_truncated, sum((cut IS NULL)::INT)::BIGINT AS n_rejected FROM a LEFT JOIN c USING (conv_id)")
def truncation_counts(spark, sf_dir):
    return D.truncation_counts(turns(spark, sf_dir), ["conv_id"], 1500, F.length("content"))


@query(f"WITH {_TRUNCATE}, c AS (SELECT conv_id, max(truncated::INT) AS cut FROM kept GROUP BY 1), a AS (SELECT DISTINCT conv_id FROM turns) SELECT (SELECT count(*) FROM kept)::BIGINT AS n_written, count(*)::BIGINT AS n, sum(coalesce(cut, 0))::BIGINT AS n_truncated, sum((cut IS NULL)::INT)::BIGINT AS n_rejected FROM a LEFT JOIN c USING (conv_id)")
def truncation_observed(spark, sf_dir):
    """The counters of a truncation, taken while its rows are written."""
    path, counts = D.write_truncated(turns(spark, sf_dir), ["conv_id"], 1500, F.length("content"), f"{folder(spark)}/truncated-{uuid.uuid4().hex}")
    n = spark.read.parquet(path).count()
    remove(spark, path)
    return spark.createDataFrame([(n, counts["n"], counts["n_truncated"], counts["n_rejected"])], "n_written long, n long, n_truncated long, n_rejected long")


@query(f"""WITH {TURNS}, p AS (SELECT *, length(content) AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS suffix FROM turns),
h AS (SELECT *, coalesce(sum(tok) FILTER (place <= 2) OVER (PARTITION BY conv_id), 0) AS head FROM p),
s AS (SELECT *, min(place) FILTER (place > 2 AND (place = n OR ((place = 3 OR role <> 'user') AND head + suffix <= 1200))) OVER (PARTITION BY conv_id) AS start FROM h)
SELECT conv_id, pos FROM s WHERE place <= 2 OR place >= start""")
def pair_truncate(spark, sf_dir):
    return W.truncate_pairs(turns(spark, sf_dir), ["conv_id"], 1200, F.length("content")).select("conv_id", "pos")


_F = FENCED.format("content")


@query(f"WITH {TURNS} SELECT conv_id, pos, CASE WHEN role = 'assistant' AND pos < max(pos) OVER (PARTITION BY conv_id) THEN content || '\n' ELSE {_F} END AS content FROM turns")
def prompt_clean(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("content", fenced(F.col("content")))
    return W.cleaned_prompt(t, ["conv_id"], "pos", "role", "content").select("conv_id", "pos", "content")


@query(f"WITH {ROLLOUT} SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step FROM grid")
def rollout_grid(spark, sf_dir):
    lengths = steps(spark, sf_dir).groupBy(*KEYS).agg(F.max("seq").alias("n"))
    return W.rollout_grid(lengths, "n").select(*KEYS, "k", "step")


@query(f"WITH {ROLLOUT} SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step, student_code, student_grade FROM rollouts")
def rollout_align(spark, sf_dir):
    return rollout_rows(spark, sf_dir).select(*KEYS, "k", "step", "student_code", "student_grade")


_MODE = f"{ROLLOUT}, done AS (SELECT *, min(step) FILTER (grade >= 90 OR grade IS NULL) OVER (PARTITION BY user_id, problem_id, k) AS stop FROM rollouts)"


@query(f"WITH {_MODE} SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step, CASE WHEN grade IS NOT NULL AND (stop IS NULL OR step <= stop) THEN 'generation' ELSE 'recording' END AS mode FROM done")
def recording_mode(spark, sf_dir):
    rows = W.recording_mode(rollout_rows(spark, sf_dir), KEYS, F.col("grade") >= 90, F.col("grade").isNull())
    return rows.select(*KEYS, "k", "step", "mode")


@query(f"WITH {ROLLOUT} SELECT user_id, problem_id, k::INTEGER AS k, coalesce(max_by(coalesce(grade >= 90, false), step), false) AS solved_last, bool_or(coalesce(grade >= 90, false)) AS solved_any FROM rollouts GROUP BY ALL")
def solved_flags(spark, sf_dir):
    rows = rollout_rows(spark, sf_dir).withColumn("won", F.coalesce(F.col("grade") >= 90, F.lit(False)))
    return W.solved(rows, KEYS, "won")


@query(f"WITH {_CUT}, n AS (SELECT user_id, problem_id FROM steps GROUP BY ALL HAVING count(*) >= 6), m AS (SELECT cut.*, count(*) OVER (PARTITION BY user_id, problem_id) AS c FROM cut SEMI JOIN n USING (user_id, problem_id)) SELECT user_id, problem_id, seq, code, grade FROM m WHERE c >= 3")
def build_trajectories(spark, sf_dir):
    return D.build_trajectories(steps(spark, sf_dir).drop("seq", "code_hash"), F.md5(F.col("code").cast("binary")), KEYS, ["ts", "event_id"], success=90).select(*KEYS, "seq", "code", "grade")


@query(f"""WITH {STEPS}, p AS (SELECT *, lag(code) OVER ({_P}) AS previous_code, count(*) OVER ({_P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_remaining FROM steps)
SELECT user_id, problem_id, seq, previous_code, n_remaining::BIGINT AS n_remaining FROM p WHERE previous_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, problem_id ORDER BY md5('g|' || user_id::VARCHAR || '|' || problem_id || '|' || seq::VARCHAR), seq) <= 1""")
def grpo_examples(spark, sf_dir):
    rows = D.grpo_rows(steps(spark, sf_dir), KEYS, 1, seed="g")
    return rows.select(*KEYS, "seq", "previous_code", F.size("remaining_codes").cast("long").alias("n_remaining"))


@query(f"""WITH {STEPS}, b AS (SELECT c.user_id, c.problem_id, c.seq, min(r.seq) AS rejected_seq FROM steps c JOIN steps r ON c.user_id = r.user_id AND c.problem_id = r.problem_id AND r.seq > c.seq AND r.grade <> c.grade GROUP BY ALL)
SELECT b.*, c.code AS chosen, r.code AS rejected FROM b JOIN steps c USING (user_id, problem_id, seq) JOIN steps r ON r.user_id = b.user_id AND r.problem_id = b.problem_id AND r.seq = b.rejected_seq""")
def dpo_pairs(spark, sf_dir):
    return D.preference_pairs(steps(spark, sf_dir), KEYS, "grade").select(*KEYS, "seq", "rejected_seq", "chosen", "rejected")


@query(f"""WITH {STEPS} SELECT user_id, problem_id, seq, rejected_seq, code AS chosen, other AS rejected FROM (SELECT *, lead(seq, 2) OVER ({_P}) AS rejected_seq, lead(code, 2) OVER ({_P}) AS other FROM steps) WHERE seq >= 2 AND other <> code AND length(code) < 2 AND length(other) < 2""")
def length_filter(spark, sf_dir):
    pairs = D.preference_pairs(steps(spark, sf_dir), KEYS, "next")
    return D.within_length(pairs, ["chosen", "rejected"], F.length, 2).select(*KEYS, "seq", "rejected_seq", "chosen", "rejected")


@query(f"""WITH {TURNS}, t AS (SELECT conv_id, pos AS target FROM turns WHERE role = 'assistant' AND pos > 2), g AS (SELECT DISTINCT conv_id FROM turns), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('|' || conv_id::VARCHAR), conv_id) AS k, count(*) OVER () AS n FROM g)
SELECT conv_id, target, CASE WHEN k <= floor(n * 20.0 / 100) THEN 'val' ELSE 'train' END AS split FROM t JOIN r USING (conv_id)""")
def sft_examples(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("content", fenced(F.col("content")))
    return D.sft_rows(t, ["conv_id"], 1 << 30, F.length("content"), "conv_id").select("conv_id", "target", "split")


_AT = f"""{TURNS}, f AS (SELECT conv_id, pos, role, length({_F}) AS tok FROM turns), t AS (SELECT conv_id, pos AS target FROM f WHERE role = 'assistant' AND pos > 2),
ctx AS (SELECT t.target, f.*, min(pos) FILTER (role = 'user') OVER w AS fu, min(CASE WHEN role = 'system' AND pos = 0 THEN 0 END) OVER w AS lead FROM t JOIN f ON f.conv_id = t.conv_id AND f.pos <= t.target WINDOW w AS (PARTITION BY f.conv_id, t.target)),
o AS (SELECT *, coalesce(CASE WHEN fu IS NOT NULL THEN pos <= fu ELSE pos <= lead END, false) AS opening, sum(tok) OVER (PARTITION BY conv_id, target ORDER BY pos DESC) AS suffix, sum(tok) OVER (PARTITION BY conv_id, target) AS total FROM ctx),
h AS (SELECT *, coalesce(sum(tok) FILTER (opening) OVER (PARTITION BY conv_id, target), 0) AS head FROM o),
k AS (SELECT *, total > 1500 AS truncated, CASE WHEN total > 1500 THEN min(pos) FILTER (NOT opening AND role = 'assistant' AND head + suffix <= 1500) OVER (PARTITION BY conv_id, target) END AS kept_from FROM h),
kept AS (SELECT * FROM k WHERE (total <= 1500 OR head <= 1500) AND (NOT truncated OR opening OR coalesce(pos >= kept_from, false))),
g AS (SELECT DISTINCT conv_id FROM turns), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('|' || conv_id::VARCHAR), conv_id) AS k, count(*) OVER () AS n FROM g)"""


@query(f"WITH {_AT} SELECT conv_id, target, max(kept_from) AS kept_from, count(*)::BIGINT AS n_messages, bool_or(truncated) AS truncated, any_value(CASE WHEN r.k <= floor(n * 20.0 / 100) THEN 'val' ELSE 'train' END) AS split FROM kept JOIN r USING (conv_id) GROUP BY conv_id, target")
def sft_truncated(spark, sf_dir):
    """Examples under a budget that cuts: where each one's context begins."""
    t = turns(spark, sf_dir).withColumn("content", fenced(F.col("content")))
    return D.sft_rows(t, ["conv_id"], 1500, F.length("content"), "conv_id").select("conv_id", "target", "kept_from", "n_messages", "truncated", "split")
