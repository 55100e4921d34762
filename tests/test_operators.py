"""Operators on tiny hand-made tables: the cases that the test tables don't have."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import metrics as M
from waymark.functions import text as X
from waymark.operators import relational as R
from waymark.operators import reports
from waymark.operators import sequence as W
from waymark.plans import datasets as D
from waymark.sources import readers, sinks

KEYS = ["u", "p"]


def steps(spark, codes, grades):
    rows = [(1, "a", i + 1, c, g) for i, (c, g) in enumerate(zip(codes, grades))]
    return spark.createDataFrame(rows, "u int, p string, seq int, code string, grade double").withColumn("code_hash", F.coalesce("code", F.lit("")))


def test_repeats_and_success(spark):
    s = steps(spark, ["", "A", "A", "B", None, "A", "B", "C"], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 7.0])
    kept = W.without_repeats(s, KEYS)
    assert [r["code"] for r in kept.orderBy("seq").collect()] == ["A", "B", None, "A", "B", "C"]
    assert [r["code"] for r in W.until_success(kept, KEYS, F.col("grade") == 100).orderBy("seq").collect()] == ["A", "B", None, "A", "B"]
    again = W.without_repeats(kept, KEYS)
    assert again.count() == kept.count()


def test_void(spark):
    s = steps(spark, list("AB"), [50.0, None]).withColumn("new", F.lit(50.0))
    assert W.without_mismatch(s, KEYS, "grade", "new").count() == 2
    assert W.without_mismatch(s.withColumn("new", F.lit(51.0)), KEYS, "grade", "new").count() == 0


@pytest.mark.parametrize("n,want", [(2, []), (3, []), (4, [(2, 4)]), (7, [(2, 4), (3, 5), (4, 6), (5, 7)])])
def test_next_pairs(spark, n, want):
    s = steps(spark, [str(i) for i in range(n)], [1.0] * n)
    assert sorted((r["seq"], r["rejected_seq"]) for r in W.next_pairs(s, KEYS).collect()) == want


def test_greedy_pairs(spark):
    s = steps(spark, list("ABCDE"), [10.0, 10.0, 20.0, 20.0, None])
    assert sorted((r["seq"], r["rejected_seq"]) for r in W.greedy_pairs(s, KEYS, "grade").collect()) == [(1, 3), (2, 4)]
    s = steps(spark, list("ABABABA"), [1.0] * 7)
    made = sorted((r["seq"], r["rejected_seq"]) for r in W.greedy_pairs(s, KEYS, "temporal").collect())
    assert made == [(1, 4), (2, 5), (3, 6), (4, 7)]
    assert W.greedy_pairs(s.limit(0), KEYS).count() == 0


def test_truncation(spark):
    rows = [(1, 0, "system", 2), (1, 1, "user", 3), (1, 2, "assistant", 4), (1, 3, "user", 4), (1, 4, "assistant", 4), (2, 0, "user", 9), (2, 1, "user", 9), (3, 0, "user", 50)]
    t = spark.createDataFrame(rows, "c int, pos int, role string, tok int")
    kept = lambda budget, c: sorted(r["pos"] for r in W.truncate_left(t, ["c"], budget, F.col("tok")).where(F.col("c") == c).collect())
    assert kept(17, 1) == [0, 1, 2, 3, 4] and kept(16, 1) == [0, 1, 4] and kept(8, 1) == [0, 1] and kept(5, 1) == [0, 1] and kept(4, 1) == []
    assert kept(17, 2) == [0] and kept(17, 3) == [] and kept(50, 3) == [0]


def test_variant_tie_and_outliers(spark):
    v = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "x")], "g string, v string")
    assert sorted(r["v"] for r in R.variants(v, "g", "v").collect()) == ["a", "x"]
    o = spark.createDataFrame([("k", x) for x in [1.0, 1.0, 1.0, 9.0]] + [("m", x) for x in [1.0, 2.0, 3.0, 4.0, 100.0]] + [("s", 5.0), (None, 1.0), ("m", None)], "g string, x double")
    left = R.without_outliers(o, "g", "x")
    assert left.where("g = 'k'").count() == 4 and left.where("x = 100").count() == 0 and left.count() == o.count() - 1


def test_split_and_numbers(spark):
    df = spark.range(103).withColumn("u", F.col("id") % 23)
    out = R.split_groups(df, "u", 20.0, "s").toPandas()
    assert len(out) == 103 and out.groupby("u")["split"].nunique().max() == 1
    assert out[out["split"] == "val"]["u"].nunique() == 4
    places = [r["n"] for r in R.number_rows(df.repartition(5), ["id"], "n").orderBy("id").collect()]
    assert places == list(range(1, 104))


def test_degradation_gaps(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.7), ("a", 4, 0.5), ("a", 5, None), ("b", 2, 0.4), ("b", 3, 0.3)]
    out = reports.degradation(spark.createDataFrame(rows, "m string, k int, x double"), ["m"], ["x"]).collect()
    assert len(out) == 1 and out[0]["delta_x"] == pytest.approx(-0.3)


def test_stratified_without_flags(spark):
    df = spark.createDataFrame([("a", None, 0.5), ("a", None, 1.0)], "m string, f boolean, x double")
    assert reports.stratified(df, ["m"], ["x"], "f").first().asDict() == {"m": "a", "x_all": 0.75, "x_solved": 0.75, "x_unsolved": 0.75}


def test_latex(spark):
    df = spark.createDataFrame([("m", "SFT", 0.5), ("m", "BASE", 0.75)], "model string, method string, x double")
    assert reports.latex_rows(df, "model", "method", ["x"], ["BASE"]) == "m & BASE & \\textbf{0.750} \\\\\nm & SFT & 0.500 \\\\\n"


def test_text_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("no fence",), ("Unit Test Returned: 5\nUnit Test Returned: 6",)], "t string")
    t = F.col("t")
    got = df.select(X.score(t), X.first_fence(t), X.student_code(t), X.is_recording(t), X.tolerant_equal(t, t)).collect()
    assert [r[0] for r in got] == [None, 0.0, 0.0, 5.0] and all(r[1] is None for r in got) and [r[3] for r in got] == [True, True, False, False]


def test_prompts(spark):
    with pytest.raises(ValueError):
        X.system_prompt("other")
    row = spark.range(1).select(X.system_prompt("code"), X.leave_messages(F.lit(40.0)).alias("m")).first()
    assert row[0] and [m["role"] for m in row["m"]] == ["assistant", "user"]
    said = spark.createDataFrame([(row["m"][0]["content"], row["m"][1]["content"])], "a string, u string")
    assert tuple(said.select(X.gives_up(X.python_code(F.col("a"))), X.score(F.col("u"))).first()) == (True, 40.0)


def test_penalty_and_reward(spark):
    df = spark.createDataFrame([(0,), (855,), (950,), (951,)], "n int")
    assert [r[0] for r in df.select(M.length_penalty(F.col("n"), 1000)).collect()] == [0.0, 0.0, -1.0, -1.0]
    yes, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(M.reward(no, no, no, no, F.lit(1.0), F.lit(1.0), F.lit(0.0)), M.reward(yes, yes, yes, no, F.lit(1.0), F.lit(1.0), F.lit(-1.0))).first()
    assert tuple(row) == (-0.75, 0.5)


def test_structural_filter(spark):
    rows = [("l_1", "d", "c", "u", 40.0, 1, "t", "lab", False, False), ("l_1", "d", "c", "u", 60.0, 2, "t", "lab", False, False), ("l_2", "d", "c", "u", 60.0, 2, "t", "lab", False, True), ("l_3", "d.csv", "c", "u", 90.0, 2, "t", "lab", False, False), ("x_1", "d", "c", "u", 90.0, 2, None, "lab", None, None), ("y_1", "d", "c", "u", 10.0, 2, "t", "lab", False, False)]
    log = spark.createDataFrame(rows, "problem_id string, problem_description string, code string, user string, grade double, timestamp int, testcase string, type string, redacted boolean, exam boolean")
    assert sorted(r["problem_id"] for r in D.structural_filter(log, exams=False).collect()) == ["l_1", "l_1", "x_1"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None, "train"), (2, 'q"x', None, "val")], "id int, text string, none string, split string")
    sinks.write_dataset(df, f"{tmp_path}/d")
    assert readers.scan_split(spark, f"{tmp_path}/d", "val").count() == 1 and readers.scan_split(spark, f"{tmp_path}/d").count() == 2
    sinks.write_csv(df.withColumn("m", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))), f"{tmp_path}/c")
    back = readers.read_csv(spark, f"{tmp_path}/c")
    assert set(back.columns) == {"id", "text", "split", "m"}
    assert sorted(r[0] for r in back.select(readers.decode_messages(F.col("m"))[0]["content"]).collect()) == ["a\nb", 'q"x']
    sinks.append_round(df, f"{tmp_path}/r", 1)
    sinks.append_round(df, f"{tmp_path}/r", 1)
    sinks.append_round(df, f"{tmp_path}/r", 2)
    assert spark.read.parquet(f"{tmp_path}/r").count() == 4
    assert readers.discover(spark, str(tmp_path), "part-*.parquet", "round=1").count() == 4
    sinks.write_settings(spark, {"task": {"name": "sft"}, "model": {"task": {"name": "dpo"}, "model": {}}}, f"{tmp_path}/s")
    made = readers.read_config(spark, f"{tmp_path}/s")
    assert readers.training_chain(made) == ["dpo", "sft"] and readers.setting(made, "task.none.x", 3) == 3
    assert readers.compose_config({"model": {}}, "n", 4) == {"name": "n", "id": 4, "model": {}}
    made = readers.compose_experiment(spark, "n", f"{tmp_path}/none yet", [f"{tmp_path}/[s]"], seed=7)
    assert made["id"] == 0 and made["seed"] == 7 and [d["task"]["name"] for d in made["dataset"]] == ["sft"]
    with pytest.raises(ValueError):
        readers.matching(spark, f"{tmp_path}/nothing*")


def test_keep_existing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, d int")
    assert R.keep_existing(df, ["d", "x", "b.c"]).columns == ["d", "b.c"]
    assert R.keep_existing(df, ["x"]).columns == []


def test_streaming(spark, tmp_path):
    from waymark.streaming import ingest

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = ingest.read_log(spark, f"{tmp_path}/in", events.schema)
    counted = ingest.activity(stream, "ts", ["event_type"])
    out = counted.writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", f"{tmp_path}/cp").start()
    out.processAllAvailable()
    out.stop()
    assert spark.sql("SELECT sum(n) FROM activity").first()[0] == events.count()
    seen = []
    query = ingest.start(stream, lambda df, i: seen.append(df.count()), f"{tmp_path}/cp2")
    query.awaitTermination(60)
    assert sum(seen) == events.count()
