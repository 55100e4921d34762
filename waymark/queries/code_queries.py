"""Functions on programs.  Programs are made of events; without SQL forms, tests hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import write_out
from ..functions import code as C
from ..operators.relational import small, spread
from ..plans import rollout as P
from ..plans.grading import grade_programs
from .fixtures import KEYS, ROLLOUT, steps, table
from .registry import query


def _events(spark, sf_dir):
    """Ids and values, dealt out before programs are made of them."""
    return spread(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")


def _programs(spark, sf_dir):
    """Small programs: names vary with the event, structure with its value; some don't parse."""
    name = F.concat(F.lit("x"), (F.col("event_id") % 7).cast("string"))
    number = F.floor(F.col("value") / 100).cast("long").cast("string")
    text = F.concat(F.lit("def f(a):\n    return a + 1\n"), name, F.lit(" = f("), number, F.lit(")\nprint("), name, F.lit(")\n"))
    broken = F.when(F.col("event_id") % 11 == 0, F.concat(text, F.lit("if:\n"))).otherwise(text)
    other = F.concat(F.lit("y = "), number, F.lit("\nfor i in range(y):\n    print(i)\n"))
    return _events(spark, sf_dir).select("event_id", (F.floor(F.col("value") / 100).cast("long")).alias("bucket"), broken.alias("a"), F.when(F.col("event_id") % 2 == 0, other).otherwise(broken).alias("b"))


@query("SELECT event_id, event_id % 11 <> 0 AS good FROM events")
def compiles(spark, sf_dir):
    return _programs(spark, sf_dir).select("event_id", C.udf("compiles")("a").alias("good"))


#: Breakages of the program below, by number: none, an open header, a missing colon, an open string, a lone if, a stray bracket.
_BROKEN = 6


def _worn_programs(spark, sf_dir):
    """Programs whole and broken; names, blanks, comments and widths of indents vary with the event."""
    e = F.col("event_id")
    number = F.floor(F.col("value") / 100).cast("long").cast("string")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (e % n + 1).cast("int"))
    name, other = F.concat(F.lit("n"), (e % 7).cast("string")), F.concat(F.lit("m"), (e % 5).cast("string"))
    blank, indent, note = pick(3, "", " ", "  "), pick(4, "  ", "    ", "\t", "   "), pick(5, "", "  # a note", "", "", "\n\n# lines")
    head = F.element_at(F.array(*map(F.lit, ("):", ":", ")", "):", "):", "):"))), (F.floor(e / 7) % _BROKEN + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("", "", "", "print('open\n", "if:\n", "x = 2)\n"))), (F.floor(e / 7) % _BROKEN + 1).cast("int"))
    lines = [F.concat(F.lit("def f("), name, head, note), F.concat(indent, F.lit("return"), F.lit(" "), name, blank, F.lit("+"), blank, number), F.concat(other, blank, F.lit("="), blank, F.lit("f("), number, F.lit(")")), F.concat(F.lit("print("), other, F.lit(")"), note)]
    return _events(spark, sf_dir).select("event_id", F.concat(*(x for line in lines for x in (line, F.lit("\n"))), tail).alias("code"))


@query(f"""WITH p AS (SELECT event_id, event_id // 7 % {_BROKEN} AS kind, floor(value / 100)::BIGINT AS bucket FROM events)
SELECT event_id, min(event_id) OVER w AS class_id, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY kind, bucket)""")
def code_hash_classes(spark, sf_dir):
    """The class of each program, whole or broken: those alike up to names and blanks.  Texts are
    hashed where they lie; only hashes are grouped and joined."""
    named = write_out(_worn_programs(spark, sf_dir).select("event_id", C.udf("code_hash")("code").alias("h")))
    classes = named.groupBy("h").agg(F.min("event_id").alias("class_id"), F.count("*").alias("n"))
    return named.join(small(classes), "h").select("event_id", "class_id", "n")


@query("SELECT event_id, true AS same FROM events")
def diff_round_trip(spark, sf_dir):
    rows = _programs(spark, sf_dir).withColumn("d", C.udf("unified_diff")("a", "b"))
    return rows.select("event_id", (F.rtrim(C.udf("apply_diff")("a", "d"), F.lit("\n")) == F.rtrim("b", F.lit("\n"))).alias("same"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS kind, floor(value / 100)::BIGINT::VARCHAR AS t FROM events), c AS (
SELECT event_id, unnest(CASE kind
  WHEN 1 THEN [{'hunk': 0, 'old_start': 3, 'place': 0, 'op': '-', 'line': 'a2 = ' || t}, {'hunk': 0, 'old_start': 3, 'place': 1, 'op': '+', 'line': '--c2 = ' || t}]
  WHEN 2 THEN [{'hunk': 0, 'old_start': 1, 'place': 0, 'op': '-', 'line': 'a0 = ' || t}, {'hunk': 0, 'old_start': 1, 'place': 1, 'op': '+', 'line': 'b0 = ' || t}, {'hunk': 1, 'old_start': 6, 'place': 0, 'op': '-', 'line': 'a5 = ' || t}]
  WHEN 3 THEN [{'hunk': 0, 'old_start': 6, 'place': 0, 'op': '+', 'line': 'z = ' || t}] ELSE [] END) AS x FROM e)
SELECT event_id, x.hunk::INTEGER AS hunk, x.old_start::INTEGER AS old_start, x.place::INTEGER AS place, x.op AS op, x.line AS line FROM c""")
def diff_hunks(spark, sf_dir):
    """Changes of generated diffs as rows: none, a line replaced, one replaced and one gone, one added."""
    t, kind = F.floor(F.col("value") / 100).cast("long").cast("string"), F.col("event_id") % 4
    line = lambda name: F.concat(F.lit(f"{name} = "), t, F.lit("\n"))
    text = lambda *names: F.concat(*map(line, names))
    a = text("a0", "a1", "a2", "a3", "a4", "a5")
    b = F.when(kind == 1, text("a0", "a1", "--c2", "a3", "a4", "a5")).when(kind == 2, text("b0", "a1", "a2", "a3", "a4")).when(kind == 3, text("a0", "a1", "a2", "a3", "a4", "a5", "z")).otherwise(a)
    rows = _events(spark, sf_dir).select("event_id", C.udf("unified_diff")(a, b).alias("d"))
    return C.with_diff_changes(rows, "d").drop("d")


#: Of loops over range(N): the same, another N, a print more after it.
_PAIRS = "(SELECT event_id, event_id % 3 AS kind FROM events)"


@query(f"""SELECT event_id, [0, 1, 4][kind + 1]::DOUBLE AS token_edits, [0.0, 1.0 / 14, 4.0 / 18][kind + 1]::DOUBLE AS token_distance, [0.0, 1.0 / 14, 4.0 / 14][kind + 1]::DOUBLE AS token_edits_over_source,
  [0, 0, 5][kind + 1]::DOUBLE AS tree_edits, [0.0, 0.0, 5.0 / 19][kind + 1]::DOUBLE AS tree_distance, [0.0, 0.0, 5.0 / 14][kind + 1]::DOUBLE AS tree_edits_over_source, [0.0, 0.2, 1.0 / 11][kind + 1]::DOUBLE AS rouge_distance,
  [0.0, 0.5, 1.0 / 9][kind + 1]::DOUBLE AS rouge2_distance, [0.0, 0.2, 1.0 / 11][kind + 1]::DOUBLE AS rouge_l_distance, [0.0, 0.2, 1.0 / 11][kind + 1]::DOUBLE AS rouge_lsum_distance, [1.0, 22.0 / 24, 24.0 / 28][kind + 1]::DOUBLE AS token_similarity FROM {_PAIRS}""")
def known_distances(spark, sf_dir):
    """Distances of programs whose differences are known."""
    n, kind = F.floor(F.col("value") / 100).cast("long"), F.col("event_id") % 3
    loop = lambda number: F.concat(F.lit("for i in range("), number.cast("string"), F.lit("):\n    print(i)\n"))
    b = F.when(kind == 1, loop(n + 1)).when(kind == 2, F.concat(loop(n), F.lit("print(0)\n"))).otherwise(loop(n))
    pairs = _events(spark, sf_dir).select("event_id", loop(n).alias("a"), b.alias("b"))
    names = ["token_edits", "token_distance", "token_edits_over_source", "tree_edits", "tree_distance", "tree_edits_over_source", "rouge_distance", "rouge2_distance", "rouge_l_distance", "rouge_lsum_distance", "token_similarity"]
    return pairs.select("event_id", *(C.udf(x)("a", "b").alias(x) for x in names))


@query()
def code_distances(spark, sf_dir):
    names = ["token_distance", "token_edits", "token_similarity", "tree_edits", "tree_distance", "bleu_distance", "rouge_distance"]
    return _programs(spark, sf_dir).select("event_id", *(C.udf(n)("a", "b").alias(n) for n in names))


@query()
def codebleu(spark, sf_dir):
    return _programs(spark, sf_dir).select("event_id", C.udf("codebleu")("a", "b").alias("codebleu"))


@query("""WITH p AS (SELECT event_id, 'x' || event_id % 7 AS x, floor(value / 100)::BIGINT::VARCHAR AS n, event_id % 11 = 0 AS broken FROM events),
t AS (SELECT *, [x, '=', 'f', '(', n, ')', 'print', '(', x, ')'] || CASE WHEN broken THEN ['if', ':'] ELSE [] END AS rest FROM p)
SELECT event_id, ['def', 'f', '(', 'a', ')', ':', 'return', 'a', '+', '1'] || rest AS plain, ['def', 'f', '(', 'a', ')', ':', '    ', 'return', 'a', '+', '1', ''] || rest AS indented,
  CASE WHEN NOT broken THEN 'def f(a):
    return a + 1
' || x || ' = f(' || n || ')
print(' || x || ')' END AS printed, CASE WHEN NOT broken THEN 23.0::DOUBLE END AS size FROM t""")
def python_tokens(spark, sf_dir):
    return _programs(spark, sf_dir).select("event_id", C.udf("tokens_with_comments")("a").alias("plain"), C.udf("tokens_with_indents")("a").alias("indented"), C.udf("reprinted")("a").alias("printed"), C.udf("tree_size")("a").alias("size"))


@query("""SELECT event_id, CASE WHEN kind IN (1, 2) THEN 'diff' ELSE 'full' END AS one_block, CASE WHEN kind IN (1, 2, 3) THEN 'diff' ELSE 'full' END AS content_diff,
  CASE WHEN kind = 0 OR event_id % 5 = 0 THEN 'full' ELSE 'diff' END AS progression FROM (SELECT event_id, event_id % 5 AS kind FROM events)""")
def representations(spark, sf_dir):
    """How a change is shown by each strategy: none before, one line of six changed, one line added,
    two lines far apart changed, all lines changed; the grade changes in every fifth."""
    kind = F.col("event_id") % 5
    tail = F.floor(F.col("value") / 100).cast("long").cast("string")
    line = lambda *more: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in more), F.lit("\n"))
    before = F.concat(*(line(f"a{i} = b + ", tail) for i in range(6)))
    changed = lambda *at: F.concat(*(line(f"a{i} = c + ", tail) if i in at else line(f"a{i} = b + ", tail) for i in range(6)))
    after = F.when(kind.isin(0, 1), changed(2)).when(kind == 2, F.concat(before, line("q = ", tail))).when(kind == 3, changed(0, 5)).otherwise(F.concat(*(line(f"w({i}, 'z')") for i in range(9))))
    rows = _events(spark, sf_dir).select("event_id", F.when(kind > 0, before).alias("p"), after.alias("n"), (kind == 0).alias("moved"))
    return rows.select("event_id", *(C.shown_as(F.col("p"), F.col("n"), s, F.col("moved")).alias(s) for s in ("one_block", "content_diff", "progression")))


@query("SELECT event_id, floor(value / 100)::BIGINT::VARCHAR || '\nb' AS code FROM events")
def reconstruct(spark, sf_dir):
    first = F.concat(F.lit("```python\na\nb\n```"))
    second = F.concat(F.lit("```diff\n@@ -1 +1 @@\n-a\n+"), F.floor(F.col("value") / 100).cast("long").cast("string"), F.lit("\n```"))
    return _events(spark, sf_dir).select("event_id", C.udf("reconstruct")(F.array(first, second)).alias("code"))


@query("""SELECT s_suppkey, n_name AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def closest_name(spark, sf_dir):
    """Of all names of a region the one closest to a worn name: a letter exchanged, one added."""
    nations = table(spark, sf_dir, "nation")
    names = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_name")).alias("names"))
    rows = table(spark, sf_dir, "supplier").join(nations.join(names, "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", C.udf("closest")(F.concat(F.translate("n_name", "E", "3"), F.lit("x")), "names").alias("best"))


def _rollout(spark, sf_dir, predict, **more):
    s = steps(spark, sf_dir)
    opening = s.where("seq = 1").select(*KEYS, F.lit(0).alias("pos"), F.lit("system").alias("role"), F.lit("Go").alias("content"))
    said = s.select(*KEYS, (2 * F.col("seq")).cast("int").alias("pos"), F.lit("assistant").alias("role"), F.concat(F.lit("```python\n"), F.col("code"), F.lit("\n```")).alias("content"))
    grade = P.by_column(lambda code: F.least(code.try_cast("double") * 2, F.lit(100.0)))
    return P.rollout(s, opening.unionByName(said), KEYS, predict, grade, rounds=3, **more)


@query(f"""WITH {ROLLOUT}, base AS (
  SELECT g.user_id, g.problem_id, g.k, g.step, t.code AS student_code, t.grade AS student_grade, b.code::BIGINT AS first FROM grid g
  JOIN steps t ON t.user_id = g.user_id AND t.problem_id = g.problem_id AND t.seq = g.k + g.step - 1
  JOIN steps b ON b.user_id = g.user_id AND b.problem_id = g.problem_id AND b.seq = g.k - 1 WHERE g.step <= 3),
alive AS (SELECT *, step = 1 OR (first + step - 1) * 2 < 100 AS live FROM base)
SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step, CASE WHEN live THEN (first + step)::VARCHAR ELSE '' END AS code, CASE WHEN live THEN least((first + step) * 2, 100)::DOUBLE END AS grade,
  student_code, student_grade, CASE WHEN live THEN 'generation' ELSE 'recording' END AS mode, live AND (first + step) * 2 >= 100 AS successful FROM alive""")
def rollout_loop(spark, sf_dir):
    """A rollout with a deterministic stand-in for a model: its last program, plus one."""

    def predict(conversations: list[list[dict]]) -> list[str]:
        last = [[m["content"] for m in ms if m["role"] == "assistant"][-1] for ms in conversations]
        return [f"```python\n{int(''.join(c for c in text if c.isdigit()) or 0) + 1}\n```" for text in last]

    out = _rollout(spark, sf_dir, predict)
    return out.select(*KEYS, "k", "step", "code", "grade", "student_code", "student_grade", "mode", "successful")


@query(f"WITH {ROLLOUT} SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step, '' AS code, step = 1 AND k > 2 AS over_budget FROM grid WHERE step <= 3")
def rollout_budget(spark, sf_dir):
    """Each turn costs one; the two first turns and the last one reach the budget and end their
    task, whose rows stay.  The stand-in's answers are empty, so every other task ends as well."""
    out = _rollout(spark, sf_dir, lambda conversations: ["```python\n```" for _ in conversations], budget=3, tokens=lambda content: F.lit(1))
    return out.select(*KEYS, "k", "step", "code", "over_budget")


@query(f"""WITH {ROLLOUT}, seen AS (
  SELECT user_id, problem_id, k, step, CASE step WHEN 1 THEN least(k, 5) WHEN 2 THEN least(k + 2, 5) ELSE 4 END AS n,
    CASE WHEN step = 1 AND k > 2 THEN greatest(2, k - 3) WHEN step = 2 AND k > 2 THEN k - 1 END AS third FROM grid WHERE step <= 3),
answers AS (SELECT g.*, printf('%d.%03d', n, coalesce(s.code::BIGINT, 0)) AS code FROM seen g LEFT JOIN steps s ON s.user_id = g.user_id AND s.problem_id = g.problem_id AND s.seq = g.third)
SELECT user_id, problem_id, k::INTEGER AS k, step::INTEGER AS step, code, code::DOUBLE * 2 AS grade, false AS over_budget FROM answers""")
def rollout_shortened(spark, sf_dir):
    """A rollout whose prompts are shortened and then answered: each turn costs two of eleven.

    The stand-in answers with the number of messages that it was shown and with the program in
    the third, the oldest that the shortening left after the two first (0 if it is its own).
    """

    def predict(conversations: list[list[dict]]) -> list[str]:
        third = [ms[2]["content"] if len(ms) > 2 else "" for ms in conversations]
        number = ["" if "." in text else "".join(c for c in text if c.isdigit()) for text in third]
        return [f"```python\n{len(ms)}.{int(n or 0):03d}\n```" for ms, n in zip(conversations, number)]

    out = _rollout(spark, sf_dir, predict, budget=11, tokens=lambda content: F.lit(2))
    return out.select(*KEYS, "k", "step", "code", "grade", "over_budget")


@query("SELECT n_nationkey, n_nationkey::DOUBLE AS grade, n_name AS said FROM nation")
def grade_run(spark, sf_dir):
    """Programs run in processes of their own: each prints its nation's name, its test compares."""
    number = F.col("n_nationkey").cast("string")
    test = F.concat(F.lit("score = "), number, F.lit(" if program_output == '"), F.col("n_name"), F.lit("' else -1"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("print('"), F.col("n_name"), F.lit("', end='')")).alias("code"), test.alias("testcase"))
    return grade_programs(rows, ["n_nationkey"]).select("n_nationkey", F.col("new_grade").alias("grade"), F.col("output").alias("said"))


#: A program that leaves a process in a session of its own, which writes a full score wherever it can.
_FORGERY = """import glob, os, time
if os.fork():
    os._exit(0)
os.setsid()
while True:
    for folder in glob.glob('/tmp/tmp*'):
        for name in ('result', 'output', 'score'):
            try:
                open(folder + '/' + name, 'w').write('100.0')
            except OSError:
                pass
    time.sleep(0.01)
"""


@query("SELECT r_regionkey, unnest(['forged', 'honest']) AS kind, CASE kind WHEN 'honest' THEN r_regionkey::DOUBLE + 1 ELSE 0 END AS grade FROM region")
def grade_forgeries(spark, sf_dir):
    """Programs that try to write scores, their own or others', beside honest ones."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(F.lit("forged"), F.lit("honest"))).alias("kind"))
    honest = F.col("kind") == "honest"
    test = F.concat(F.lit("import time\ntime.sleep(0.2)\nscore = "), F.when(honest, (F.col("r_regionkey") + 1).cast("string")).otherwise("0"))
    rows = regions.withColumn("code", F.when(honest, "print(1)").otherwise(_FORGERY)).withColumn("testcase", test)
    return grade_programs(rows, ["r_regionkey", "kind"]).select("r_regionkey", "kind", F.col("new_grade").alias("grade"))
