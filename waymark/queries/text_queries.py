"""Text extraction and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import readers, sinks
from .fixtures import FENCED, TURNS, fenced, table, turns
from .registry import query

_W = "[ \\t\\n\\x0B\\f\\r]"
_TAG = "'a <actual_submission>\n ' || content || ' \n</actual_submission> b'"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _tagged():
    return F.concat(F.lit("a <actual_submission>\n "), F.col("content"), F.lit(" \n</actual_submission> b"))


@query(f"WITH {TURNS} SELECT conv_id, pos, '```python\n' || content || '\n```' AS block FROM turns")
def fence_first(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "pos", X.first_fence(fenced(F.col("content"))).alias("block"))


@query(f"WITH {TURNS} SELECT conv_id, pos, '```b\n' || role || '```' AS block FROM turns")
def fence_last(spark, sf_dir):
    text = F.concat(fenced(F.col("content")), F.lit("x ```b\n"), F.col("role"), F.lit("``` y"))
    return turns(spark, sf_dir).select("conv_id", "pos", X.last_fence(text).alias("block"))


@query(f"WITH {TURNS} SELECT conv_id, pos, CASE WHEN pos % 2 = 0 THEN {_strip('content')} END AS code FROM turns")
def fenced_code(spark, sf_dir):
    text = F.when(F.col("pos") % 2 == 0, fenced(F.col("content"))).otherwise(F.col("content"))
    return turns(spark, sf_dir).select("conv_id", "pos", X.fenced_code(text).alias("code"))


@query(f"WITH {TURNS} SELECT conv_id, pos, {_strip('content')} AS python, {_strip('content')} AS cut_short, {_strip('content')} AS plain FROM turns")
def model_code(spark, sf_dir):
    c = F.col("content")
    return turns(spark, sf_dir).select("conv_id", "pos", X.python_code(fenced(c)).alias("python"), X.model_code(F.concat(F.lit("```python\n"), c)).alias("cut_short"), X.model_code(c).alias("plain"))


@query(f"WITH {TURNS} SELECT conv_id, pos, CASE WHEN pos % 3 = 2 THEN NULL ELSE {_strip('content')} END AS code FROM turns")
def student_code(spark, sf_dir):
    c = F.col("content")
    text = F.when(F.col("pos") % 3 == 0, _tagged()).when(F.col("pos") % 3 == 1, F.concat(F.lit("```\n"), c, F.lit("\n```"))).otherwise(c)
    return turns(spark, sf_dir).select("conv_id", "pos", X.student_code(text).alias("code"))


@query(f"WITH {TURNS} SELECT conv_id, pos, {_strip('content')} AS tagged, NULL::VARCHAR AS untagged, CASE WHEN role = 'assistant' THEN 'a  b' ELSE {_TAG} END AS bare FROM turns")
def tag_strip(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "pos", X.submission(_tagged()).alias("tagged"), X.submission(F.col("role")).alias("untagged"), X.without_submission(F.col("role"), _tagged()).alias("bare"))


@query(f"WITH {TURNS} SELECT conv_id, pos, regexp_replace({FENCED.format('content')}, '(?s)<think>.*?</think>', '', 'g') AS text FROM turns")
def think_strip(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "pos", X.without_thoughts(fenced(F.col("content"))).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN NULL ELSE round(value, 2) END::DOUBLE AS score, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 2 = 0 THEN round(value, 2) END::DOUBLE AS grade FROM events")
def score_parse(spark, sf_dir):
    shown = F.round("value", 2).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, "no line").when(F.col("event_id") % 3 == 1, "x\nUnit Test Returned: many\n").otherwise(F.concat(F.lit("x\nUnit Test Returned: "), shown, F.lit("\nUnit Test Returned: 7")))
    enabled = (F.col("event_id") % 2 == 0) | (F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", X.score(text).alias("score"), X.feedback_grade(text, enabled).alias("grade"))


@query(f"WITH {TURNS} SELECT conv_id, max_by(pos * 10.0, pos) FILTER (role = 'user')::DOUBLE AS final_grade FROM turns GROUP BY conv_id")
def final_grade(spark, sf_dir):
    text = F.concat(F.lit("Unit Test Returned: "), (F.col("pos") * 10).cast("string"))
    rows = turns(spark, sf_dir).withColumn("grade", X.score(text))
    return rows.groupBy("conv_id").agg(F.max_by("grade", F.when(F.col("role") == "user", F.col("pos"))).alias("final_grade"))


@query("SELECT event_id, event_id % 4 <> 3 AS quits, event_id % 4 = 0 OR event_id % 4 = 2 AS records FROM events")
def giveup_detect(spark, sf_dir):
    code = F.element_at(F.array(F.lit("exit() # bye"), F.lit("# gone\nquit"), F.lit(" exit\n"), F.lit("x = 1")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.gives_up(code).alias("quits"), X.is_recording(code).alias("records"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+'))::BIGINT AS n_tokens, regexp_extract_all(text, '[0-9A-Za-z_]+')[1] AS first_token FROM documents")
def word_tokens(spark, sf_dir):
    words = X.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.try_element_at(words, F.lit(1)).alias("first_token"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'Correct!' ELSE 'Not correct yet.' END AS feedback FROM events")
def feedback_masking(spark, sf_dir):
    grade = F.when(F.col("event_id") % 3 == 0, 100).otherwise(50)
    return table(spark, sf_dir, "events").select("event_id", X.masked_feedback(F.col("event_type"), grade, F.col("event_id") % 2 == 0).alias("feedback"))


@query("SELECT n_nationkey, upper(string_split(n_name, '_')[-1]) AS format, CASE WHEN n_nationkey % 2 = 0 THEN 'BASE' ELSE 'SFT-DPO' END AS method FROM nation")
def label_method(spark, sf_dir):
    chain = F.when(F.col("n_nationkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("sft"), F.lit("dpo")))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.experiment_format(F.concat(F.lit("run_1_"), F.lower("n_name"))).alias("format"), X.method_label(chain).alias("method"))


@query("SELECT r_regionkey, 'Dear ' || r_name || ', no ' || r_regionkey::VARCHAR AS text, ['name', 'no'] AS names FROM region")
def template_fill(spark, sf_dir):
    t = F.lit("Dear {name}, no {no}")
    return table(spark, sf_dir, "region").select("r_regionkey", X.fill_template(t, {"name": F.col("r_name"), "no": F.col("r_regionkey").cast("string")}).alias("text"), X.placeholders(t).alias("names"))


@query("SELECT r_regionkey, [r_name, r_name, 'x', 'x'] AS twice FROM region")
def repeat_elements(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", X.repeat_each(F.array("r_name", F.lit("x")), 2).alias("twice"))


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def md5_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.md5(F.col("text")).alias("hash"))


@query("SELECT p_partkey, contains(lower(p_name), 'a') AS has_a, starts_with(p_type, 'S') AS is_s, position('e' IN lower(p_name))::INTEGER AS at_e FROM part")
def text_search(spark, sf_dir):
    low = F.lower("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.contains(low, F.lit("a")).alias("has_a"), F.startswith("p_type", F.lit("S")).alias("is_s"), F.locate("e", low).alias("at_e"))


@query("SELECT event_id, 'assert score\nrun(' || event_id::VARCHAR || ')' || '\nmain()' AS test FROM events")
def template_rewrite(spark, sf_dir):
    case = F.concat(F.lit("import grader\nassert score\nrun("), F.col("event_id").cast("string"), F.lit(")\n"))
    return table(spark, sf_dir, "events").select("event_id", X.test_script(case, ["import grader"], "main()").alias("test"))


@query("SELECT event_id, event_id % 3 <> 2 AS same FROM events")
def tolerant_equals(spark, sf_dir):
    n, third = F.col("event_id"), F.col("event_id") % 3
    b = F.when(third == 0, n.cast("string")).when(third == 1, (n + 0.005).cast("string")).otherwise((n + 0.5).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.tolerant_equal(n.cast("string"), b).alias("same"))


@query(f"WITH {TURNS} SELECT conv_id, pos, len(string_split(content, '\n'))::INTEGER AS n_same, 1::INTEGER AS n_first FROM turns")
def line_match(spark, sf_dir):
    c = F.col("content")
    return turns(spark, sf_dir).select("conv_id", "pos", X.matching_lines(c, F.concat(c, F.lit("  \nmore"))).alias("n_same"), X.matching_lines(F.concat(F.lit("a\n"), c), F.concat(F.lit(" a\nb\n"), F.lit("c"))).alias("n_first"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::DOUBLE AS raw, round(levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS longer, round(levenshtein(p_name, p_type)::DOUBLE / length(p_name), 6) AS source FROM part")
def char_edit_distance(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.char_distance(a, b).alias("raw"), F.round(X.char_distance(a, b, "longer"), 6).alias("longer"), F.round(X.char_distance(a, b, "source"), 6).alias("source"))


@query(f"WITH {TURNS} SELECT conv_id, pos, round(2.0::DOUBLE / len(string_split({_strip('content')}, '\n')), 6) AS ratio, 1::INTEGER AS n_hunks FROM turns")
def change_ratio(spark, sf_dir):
    diff = F.lit("--- a\n+++ b\n@@ -1 +1 @@\n-old @@ x\n+new")
    return turns(spark, sf_dir).select("conv_id", "pos", F.round(X.change_ratio(diff, F.col("content")), 6).alias("ratio"), X.hunk_count(diff).cast("int").alias("n_hunks"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def strip_quotes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.problem_turn(F.concat(F.lit('  ""'), F.col("n_name"), F.lit('" \n'))).alias("name"))


@query(f"WITH {TURNS} SELECT conv_id, pos, role AS r, content AS c FROM turns")
def nested_decode(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("json", F.to_json(F.array(F.struct("role", "content"))))
    m = readers.decode_messages(F.col("json"))[0]
    return rows.select("conv_id", "pos", m["role"].alias("r"), m["content"].alias("c"))


@query(f"WITH {TURNS}, k AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM turns) SELECT conv_id, sum((NOT (pos = last AND role = 'assistant'))::INT)::BIGINT AS n_sent, 'm1' AS model FROM k GROUP BY conv_id")
def request_lines(spark, sf_dir):
    from ..operators.sequence import to_messages

    rows = to_messages(turns(spark, sf_dir), ["conv_id"]).withColumn("custom_id", F.col("conv_id").cast("string"))
    sent = F.from_json("value", "custom_id string, body struct<messages: array<struct<pos:int,role:string,content:string>>, model: string>")
    out = sinks.request_lines(rows, model="m1").select(sent.alias("v"))
    return out.select(F.col("v.custom_id").cast("long").alias("conv_id"), F.size("v.body.messages").cast("long").alias("n_sent"), F.col("v.body.model").alias("model"))


@query("SELECT DISTINCT r_regionkey, r_name FROM region")
def split_scan(spark, sf_dir):
    return readers.read_inputs(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/region.parquet"]).distinct()
