"""Filters, joins, aggregates, order, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import relational as R
from ..operators import sequence as W
from .fixtures import KEYS, STEPS, TURNS, steps, table, turns
from .registry import query


@query(f"""WITH {STEPS}, kept AS (SELECT s.* FROM steps s SEMI JOIN (SELECT user_id, problem_id FROM steps GROUP BY ALL HAVING max_by(grade, seq) >= 50) g USING (user_id, problem_id)),
fresh AS (SELECT * FROM (SELECT *, lag(code, 1, '') OVER (PARTITION BY user_id, problem_id ORDER BY seq) AS before FROM kept) WHERE code <> before),
cut AS (SELECT *, coalesce(sum((grade >= 90)::INT) OVER (PARTITION BY user_id, problem_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM fresh)
SELECT problem_id, count(*)::BIGINT AS n_steps, round(avg(grade), 6) AS avg_grade, sum((grade >= 90)::BIGINT)::BIGINT AS n_success FROM cut WHERE won = 0 GROUP BY problem_id""")
def solved_trajectories(spark, sf_dir):
    """Flagship: solved groups, repeats removed, cut at the first success, by task."""
    rows = R.having_last_at_least(steps(spark, sf_dir), KEYS, "grade", ["seq"], 50)
    rows = W.until_success(W.without_repeats(rows, KEYS, "code_hash"), KEYS, F.col("grade") >= 90)
    return rows.groupBy("problem_id").agg(F.count("*").alias("n_steps"), F.round(F.avg("grade"), 6).alias("avg_grade"), F.sum((F.col("grade") >= 90).cast("long")).alias("n_success"))


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq, grade FROM steps SEMI JOIN (SELECT user_id, problem_id FROM steps GROUP BY ALL HAVING max_by(grade, seq) >= 50) g USING (user_id, problem_id)")
def solved_group_filter(spark, sf_dir):
    return R.having_last_at_least(steps(spark, sf_dir), KEYS, "grade", ["seq"], 50).select(*KEYS, "seq", "grade")


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def canonical_variant(spark, sf_dir):
    return R.variants(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1)
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders SEMI JOIN b USING (o_custkey, o_orderpriority)""")
def canonical_rows(spark, sf_dir):
    return R.canonical_variant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderpriority")


@query(f"""WITH {STEPS}, t AS (SELECT user_id, problem_id, count(*)::BIGINT AS n FROM steps GROUP BY ALL), m AS (SELECT *, median(n) OVER (PARTITION BY problem_id) AS med FROM t),
d AS (SELECT *, abs(n - med) AS off FROM m), s AS (SELECT *, median(off) OVER (PARTITION BY problem_id) AS mad FROM d)
SELECT user_id, problem_id, n FROM s WHERE mad = 0 OR 0.6745::DOUBLE * off / mad <= 2.5""")
def mad_outliers(spark, sf_dir):
    lengths = steps(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return R.without_outliers(lengths, "problem_id", "n", 2.5).select(*KEYS, "n")


@query("SELECT doc_id, lang FROM documents WHERE NOT contains(coalesce(text, ''), 'token') AND NOT contains(coalesce(source, ''), 'src1')")
def not_mentioning(spark, sf_dir):
    return R.not_mentioning(R.not_mentioning(table(spark, sf_dir, "documents"), ["text"], "token"), ["source"], "src1").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R') AND l_linestatus = 'O' AND l_quantity > 25")
def conjunction(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(~(F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    return rows.where(F.col("l_quantity") > 25).select("l_orderkey", "l_linenumber")


@query(f"WITH {STEPS} SELECT user_id, problem_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY user_id, problem_id) AS c FROM steps) WHERE c >= 12")
def min_raw_length(spark, sf_dir):
    return R.at_least(steps(spark, sf_dir), KEYS, 12).select(*KEYS, "seq")


@query(f"WITH {TURNS} SELECT conv_id, count(*)::BIGINT AS n_messages FROM turns GROUP BY conv_id HAVING count(*) > 6")
def min_conversation(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_messages")).where("n_messages > 6")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def drop_nulls(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", "o_orderkey").na.drop(subset=["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_per_key(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT n_name, r_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(R.small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(R.small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT e.event_id, e.event_type, l.code FROM events e LEFT JOIN (SELECT event_type, min(props) AS code FROM events WHERE props IS NOT NULL GROUP BY 1) l USING (event_type)")
def testcase_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = R.lookup_first(events, "event_type", "props").withColumnRenamed("props", "code")
    return events.select("event_id", "event_type").join(R.small(found), "event_type", "left").select("event_id", "event_type", "code")


@query("SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT c_custkey, 'customer', c_acctbal FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def union_all(spark, sf_dir):
    kinds = (("orders", "o_orderkey", "order", "o_totalprice"), ("customer", "c_custkey", "customer", "c_acctbal"), ("supplier", "s_suppkey", "supplier", "s_acctbal"))
    return R.union_all([table(spark, sf_dir, t).select(F.col(i).alias("id"), F.lit(k).alias("kind"), F.col(a).alias("amount")) for t, i, k, a in kinds])


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS region FROM customer UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def concat_inputs(spark, sf_dir):
    return R.union_all([table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("region"))])


@query("WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_id ORDER BY event_id) AS x FROM events WHERE event_id % 3 <> 0) SELECT e.event_id AS custom_id, r.user_id AS answer FROM events e LEFT JOIN r USING (event_id)")
def request_reorder(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("custom_id"), F.col("user_id").alias("answer"))
    return R.reorder_by_request(events.select("custom_id"), events.where(F.col("custom_id") % 3 != 0))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*)::BIGINT AS n_rows, max(l_quantity) AS max_qty,
round(stddev_samp(l_quantity), 6) AS std_qty, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) AS se_qty, median(l_quantity) AS median_qty, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers FROM lineitem GROUP BY ALL""")
def aggregates(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(q).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n_rows"), F.max(q).alias("max_qty"), F.round(F.stddev_samp(q), 6).alias("std_qty"), F.round(M.standard_error(q), 8).alias("se_qty"), F.median(q).alias("median_qty"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT lang, arg_min(source, (-n, source)) AS mode_source FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def mode_value(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.mode("source", True).alias("mode_source"))


@query(f"WITH {STEPS} SELECT user_id, problem_id, max_by(grade, seq) AS grade FROM steps GROUP BY ALL")
def last_value(spark, sf_dir):
    return R.last_value(steps(spark, sf_dir), KEYS, "grade", ["seq"])


@query(f"""WITH {STEPS}, t AS (SELECT user_id, problem_id, count(*) AS n, max_by(grade, seq) AS final FROM steps GROUP BY ALL)
SELECT count(*)::BIGINT AS n_trajectories, count(DISTINCT user_id)::BIGINT AS n_users, count(DISTINCT problem_id)::BIGINT AS n_problems, avg(n) AS avg_length, sum((final >= 90)::INT)::BIGINT AS n_solved,
sum((final < 90)::INT)::BIGINT AS n_unsolved, avg(final) AS avg_final, median(final) AS median_final FROM t""")
def dataset_stats(spark, sf_dir):
    lengths = steps(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max_by("grade", "seq").alias("final"))
    return R.group_statistics(lengths, "user_id", "problem_id", "n", "final", 90)


@query(f"WITH {STEPS}, c AS (SELECT user_id, problem_id, code, count(*)::BIGINT AS n FROM steps GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, problem_id ORDER BY n DESC, code) = 1")
def representatives(spark, sf_dir):
    return R.representatives(steps(spark, sf_dir), KEYS, "code")


@query("SELECT r_name, r_regionkey FROM region ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, r_name")
def listed_order(spark, sf_dir):
    return R.in_listed_order(table(spark, sf_dir, "region"), "r_name", ["EUROPE", "ASIA"]).select("r_name", "r_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_rows(spark, sf_dir):
    """The ten greatest: the limit is the feature."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events ORDER BY md5('42' || '|' || event_id::VARCHAR), event_id LIMIT 100")
def sample_hash(spark, sf_dir):
    """A sample of 100: the number is the feature."""
    return R.sample_rows(table(spark, sf_dir, "events"), 100, ["event_id"], "42").select("event_id", "user_id")


@query("""WITH g AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42' || '|' || user_id::VARCHAR), user_id) AS k, count(*) OVER () AS n FROM g)
SELECT event_id, user_id, CASE WHEN k <= floor(n * 20.0 / 100) THEN 'val' ELSE 'train' END AS split FROM events JOIN r USING (user_id)""")
def split_by_student(spark, sf_dir):
    return R.split_groups(table(spark, sf_dir, "events"), "user_id", 20.0, "42").select("event_id", "user_id", "split")


@query("SELECT event_id, row_number() OVER (ORDER BY md5('s' || '|' || event_id::VARCHAR), event_id)::BIGINT AS place FROM events")
def shuffled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", R.hash_order("event_id", seed="s").alias("h"))
    return R.number_rows(rows, ["h", "event_id"], "place").select("event_id", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('' || '|' || event_id::VARCHAR), event_id) <= 2")
def cap_per_group(spark, sf_dir):
    return R.cap_per_group(table(spark, sf_dir, "events"), ["user_id", "event_type"], 2, [R.hash_order("event_id"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query(f"WITH {STEPS} SELECT c.user_id, c.problem_id, c.seq, arg_min(r.seq, md5('' || '|' || r.event_id::VARCHAR))::INTEGER AS pick FROM steps c JOIN steps r ON c.user_id = r.user_id AND c.problem_id = r.problem_id AND r.seq > c.seq GROUP BY ALL")
def random_choice(spark, sf_dir):
    return W.random_later(steps(spark, sf_dir), KEYS, R.hash_order("event_id")).select(*KEYS, "seq", "pick")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE event_type END AS kind, split_part(event_type || '_x', '_', 1) AS grp, 'fixed' AS origin FROM events")
def projections(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "type"})
    return rows.select("event_id", R.map_values(F.col("type"), {"click": "C", "view": "V"}).alias("kind"), X.group_prefix(F.concat("type", F.lit("_x"))).alias("grp"), F.lit("fixed").alias("origin"))


@query("SELECT CASE r_name WHEN 'ASIA' THEN 'Far East' ELSE r_name END AS r_name, r_regionkey FROM region")
def replaced_values(spark, sf_dir):
    return table(spark, sf_dir, "region").replace({"ASIA": "Far East"}, subset=["r_name"]).select("r_name", "r_regionkey")


@query("SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS n_parts, true AS near FROM lineitem GROUP BY 1")
def distinct_sketches(spark, sf_dir):
    """Sketches by flag and status, united by flag, within three per cent of the exact counts."""
    rows = table(spark, sf_dir, "lineitem")
    united = R.estimated_distinct(R.united_sketches(R.distinct_sketches(rows, ["l_returnflag", "l_linestatus"], "l_partkey"), ["l_returnflag"]))
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"))
    return exact.join(united, "l_returnflag").select("l_returnflag", "n_parts", (F.abs(F.col("n_distinct") / F.col("n_parts") - 1) < 0.03).alias("near"))
