"""Readers and writers: what is written to the shared folder and read back from there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..checkpoints import folder, remove
from ..functions import text as X
from ..operators import relational as R
from ..operators import reports
from ..plans import datasets
from ..sources import readers, sinks
from .fixtures import KEYS, STEPS, TURNS, steps, table, turns
from .registry import query


def _place(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


_SPLITS = "customers AS (SELECT c_custkey, c_name, ['train', 'val', 'test'][c_custkey % 3 + 1] AS split FROM customer)"


def _customers(spark, sf_dir):
    """A dataset of three splits, written with a folder for each."""
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    path = _place(spark)
    sinks.write_dataset(table(spark, sf_dir, "customer").select("c_custkey", "c_name", split.alias("split")), path)
    return path


@query(f"WITH {_SPLITS} SELECT c_custkey, c_name FROM customers WHERE split = 'val'")
def one_split(spark, sf_dir):
    return readers.scan_split(spark, _customers(spark, sf_dir), "val")


@query(f"WITH {_SPLITS} SELECT * FROM customers")
def all_splits(spark, sf_dir):
    return readers.scan_split(spark, _customers(spark, sf_dir))


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, 'a "quoted", line' || chr(10) || n_name AS said, '[' || n_regionkey || ',7]' AS listed FROM nation""")
def csv_round_trip(spark, sf_dir):
    """Quotes, commas and line breaks return as written, lists as JSON; the unnamed and the empty column don't."""
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("Unnamed: 0"), "n_nationkey", F.concat(F.lit('a "quoted", line\n'), F.col("n_name")).alias("said"), F.array("n_regionkey", F.lit(7).cast("long")).alias("listed"), F.lit(None).cast("string").alias("nothing")
    )
    path = _place(spark)
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path)


@query("SELECT r_regionkey, r_name, 'kept' AS found FROM region")
def discovered_files(spark, sf_dir):
    """All folders below a root but the one whose path holds a text."""
    root = _place(spark)
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows.withColumn("found", F.lit("kept")).write.parquet(f"{root}/m1/deep")
    rows.withColumn("found", F.lit("left out")).write.parquet(f"{root}/m2/one_step")
    return readers.discover(spark, root, excluding="one_step").drop("source_file")


@query("SELECT r_regionkey, unnest(['a1', 'a2']) AS input FROM region")
def glob_inputs(spark, sf_dir):
    root = _place(spark)
    for name in ("a1", "a2", "b"):
        table(spark, sf_dir, "region").select("r_regionkey", F.lit(name).alias("input")).write.parquet(f"{root}/{name}")
    return readers.read_inputs(spark, [f"{root}/a*"])


@query("SELECT r_regionkey, unnest([1, 2])::INTEGER AS round, CASE WHEN round = 2 THEN 'again' ELSE 'first' END AS run FROM region")
def appended_rounds(spark, sf_dir):
    """Two rounds, of which the second is written again after a failure."""
    path = _place(spark)
    for step, run in ((1, "first"), (2, "first"), (2, "again")):
        sinks.append_round(table(spark, sf_dir, "region").select("r_regionkey", F.lit(run).alias("run")), path, step)
    return spark.read.parquet(path)


@query("""WITH RECURSIVE e AS (SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey > 0 THEN (c_custkey // 3)::VARCHAR ELSE 'origin' END AS base, c_mktsegment AS task FROM customer), w AS (
  SELECT name, base, [task] AS chain FROM e UNION ALL SELECT w.name, e.base, list_prepend(e.task, w.chain) FROM w JOIN e ON e.name = w.base)
SELECT name, base AS origin, chain FROM w WHERE base NOT IN (SELECT name FROM e)""")
def experiment_chains(spark, sf_dir):
    """Experiments that each start from another's model: all training chains, doubled at once."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") > 0, F.expr("c_custkey div 3").cast("string")).otherwise("origin").alias("base"), F.col("c_mktsegment").alias("task"))
    return readers.training_chains(rows)


@query("""SELECT (SELECT count(*) FROM nation)::INTEGER AS id, r_regionkey AS place, lower(r_name) AS task, (SELECT count(*) FROM nation WHERE n_regionkey = 1)::INTEGER AS n_datasets FROM region""")
def composed_settings(spark, sf_dir):
    """An experiment composed of files that rows of tables were written to: a saved experiment for
    each nation, a dataset for each nation of a region, a chain of models as long as there are regions."""
    root, model = _place(spark), {}
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        model = {"task": {"name": r["r_name"].lower()}, "model": model}
    sinks.write_settings(spark, model, f"{root}/model.json")
    for n in table(spark, sf_dir, "nation").collect():
        sinks.write_settings(spark, {}, f"{root}/saved/{n['n_nationkey']}.json")
        sinks.write_settings(spark, {"n": n["n_nationkey"]}, f"{root}/data/{n['n_regionkey']}_{n['n_nationkey']}.json")
    made = readers.compose_experiment(spark, "x", f"{root}/saved", [f"{root}/data/1_*.json"], model=f"{root}/model.json")
    remove(spark, root)
    chain = list(enumerate(readers.training_chain(made["model"])))
    return spark.createDataFrame([(made["id"], i, task, len(made["dataset"])) for i, task in chain], "id int, place int, task string, n_datasets int")


@query("SELECT n_name, n_nationkey FROM nation")
def kept_columns(spark, sf_dir):
    return R.keep_existing(table(spark, sf_dir, "nation"), ["n_name", "missing", "n_nationkey"])


@query("SELECT n_nationkey, n_name FROM nation")
def empty_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("double").alias("none"), F.lit(1).alias("Unnamed: 0"))
    return R.without_empty_columns(rows)


_LOG = f"""{STEPS}, log AS (SELECT user_id AS "user", problem_id || '_' || (user_id % 2)::VARCHAR AS problem_id, event_id, grade, seq, event_id % 5 = 0 AS exam, event_id % 7 = 0 AS redacted FROM steps),
solved AS (SELECT * FROM log SEMI JOIN (SELECT "user", problem_id FROM log GROUP BY ALL HAVING max_by(grade, seq) >= 50) g USING ("user", problem_id)),
rest AS (SELECT * FROM solved WHERE NOT redacted AND NOT exam)"""


@query(f"""WITH {_LOG}, votes AS (SELECT split_part(problem_id, '_', 1) AS g, problem_id, count(*) AS n FROM rest GROUP BY ALL),
best AS (SELECT problem_id FROM votes QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, problem_id) = 1)
SELECT "user", problem_id, event_id FROM rest SEMI JOIN best USING (problem_id)""")
def without_exams(spark, sf_dir):
    """The structural filter with its optional predicate switched on."""
    s = steps(spark, sf_dir)
    log = s.select(F.col("user_id").alias("user"), F.concat("problem_id", F.lit("_"), (F.col("user_id") % 2).cast("string")).alias("problem_id"), "event_id", "grade", "seq", (F.col("event_id") % 5 == 0).alias("exam"), (F.col("event_id") % 7 == 0).alias("redacted"), F.lit("lab").alias("type"), F.lit("d").alias("problem_description"), F.lit("t").alias("testcase"))
    return datasets.structural_filter(log, exams=False, order=("seq",)).select("user", "problem_id", "event_id")


@query(f"WITH {TURNS} SELECT conv_id, pos, content AS feedback FROM turns")
def summative_feedback(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "pos", X.summative_feedback(F.col("content")).alias("feedback"))


@query("SELECT n_nationkey, ['assistant', 'user'] AS roles, '```python' || chr(10) || 'exit()' || chr(10) || '```' AS call, 'Unit Test Returned: ' || n_regionkey AS shown, n_nationkey % 2 = 1 AS diffs FROM nation")
def closing_messages(spark, sf_dir):
    """The pair of messages that ends a conversation; only the dual format speaks of diffs."""
    pair = X.leave_messages(F.col("n_regionkey"))
    opening = F.when(F.col("n_nationkey") % 2 == 1, X.system_prompt("dual")).otherwise(X.system_prompt("code"))
    return table(spark, sf_dir, "nation").select("n_nationkey", pair["role"].alias("roles"), pair[0]["content"].alias("call"), pair[1]["content"].alias("shown"), F.contains(opening, F.lit("diff")).alias("diffs"))


_SIX = "SELECT o_orderpriority AS method, o_orderstatus AS model, round(avg(o_totalprice) / 1000, 3) AS a, round(min(o_totalprice) / 1000, 3) AS b FROM orders GROUP BY ALL"


@query(f"""WITH t AS ({_SIX}), m AS (SELECT *, a = max(a) OVER (PARTITION BY model) AS best_a, b = max(b) OVER (PARTITION BY model) AS best_b FROM t),
lines AS (SELECT model, method, model || ' & ' || method || ' & ' || CASE WHEN best_a THEN format('\\textbf{{{{{{:.3f}}}}}}', a) ELSE format('{{:.3f}}', a) END || ' & ' || CASE WHEN best_b THEN format('\\textbf{{{{{{:.3f}}}}}}', b) ELSE format('{{:.3f}}', b) END || ' \\\\' AS line FROM m)
SELECT (row_number() OVER (ORDER BY model, method) - 1)::INTEGER AS place, line FROM lines""")
def latex_lines(spark, sf_dir):
    """The body of a LaTeX table, a line a row; the best value of a model is bold."""
    mean, least = (F.round(f("o_totalprice") / 1000, 3) for f in (F.avg, F.min))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("model")).agg(mean.alias("a"), least.alias("b"))
    lines = reports.latex_rows(rows, "model", "method", ["a", "b"]).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")
