"""Operator 8's word trigrams: bytes on disk, and words so frequent that no bucket holds them."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_advice import _word_models

from waymark.llm import cross_entropy
from waymark.llm import queries as own
from waymark.llm import word_ngrams as wn


def test_disk_follows_the_input(spark, tmp_path):
    """Before, joins by trigram wrote some forty times the input."""
    data = "/root/testdata/sf0.01"
    places = [*map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()), spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None) or spark.conf.get("spark.checkpoint.dir")]
    files = lambda: {p: p.stat().st_size for x in places for p in Path(x.removeprefix("file:")).rglob("*") if p.is_file()}
    before = files()
    own.op8_cross_entropy(spark, data).write.parquet(str(tmp_path / "out"))
    made = sum(size for p, size in files().items() if p not in before)
    assert 0 < made <= 4 * Path(data, "documents.parquet").stat().st_size


@pytest.mark.parametrize("outside", [False, True])
def test_words_that_no_bucket_holds(spark, monkeypatch, outside):
    """Frequent words are dealt out by their third word too, with the same result; so are empty texts and the places before a text."""
    monkeypatch.setattr(wn, "BUCKET", 64)
    monkeypatch.setattr(wn, "GATHER", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "a", *(f"w{i}" for i in range(40))], [30, 10, 10, *[1] * 40], k=rng.randint(1, 40))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "the the the the  é"), (7, ""), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    some = F.coalesce(F.col("doc_id") < 20, F.lit(False)) & (F.col("doc_id") >= 0) & (F.col("text") != "")
    plan = wn.survey([docs.select("text")])
    assert plan.buckets > 5 and len(plan.hot) >= 3 and plan.over.max() > 3
    target = docs.where(some) if outside else some
    background = docs.where("doc_id >= 10") if outside else None
    out = cross_entropy.cross_entropy_difference(docs, target, background).collect()
    assert len(out) == len(rows) and sum(r["score"] is None for r in out) == 2
    models = _word_models([texts[:20], [t for i, t in rows if not outside or (i is not None and i >= 10)]] if outside else [texts[:20], [t or "" for _, t in rows]], 1)
    found = {(r["doc_id"], r["n_tokens"]): r for r in out}
    for i, t in rows[:61]:
        words = ["", "", *t.split()]
        blank = len(t) - len("".join(words))
        want = [(blank * math.log(63) - sum(math.log(p(g)) for g in zip(words, words[1:], words[2:]))) / len(t) for p in models]
        r = found[i, len(t)]
        assert [r["target_loss"], r["background_loss"]] == pytest.approx(want)


@pytest.mark.parametrize("ids", [1 << 21, 3])
def test_rows_are_marked(spark, monkeypatch, ids):
    """Few ids are broadcast, many are met after a Bloom filter."""
    monkeypatch.setattr(cross_entropy, "IDS", ids)
    docs = spark.createDataFrame([(i % 90, f"t{i}") for i in range(100)] + [(None, "n")], "doc_id long, text string")
    rows = cross_entropy.marked(docs, spark.range(0, 180, 3).select(F.col("id").alias("doc_id")), "has").collect()
    assert sorted((r["text"], r["has"]) for r in rows) == sorted([*((f"t{i}", i % 90 % 3 == 0) for i in range(100)), ("n", False)])


def test_packed_numbers_come_back():
    import numpy as np
    import pyarrow as pa

    arrays = [np.array([], np.uint64), np.array([0, 0]), np.array([1, 300, 1 << 40]), np.array([(1 << 64) - 1, 5], np.uint64)]
    back = wn.unpack(pa.py_buffer(wn.pack(*arrays)))
    assert [x.tolist() for x in back] == [x.tolist() for x in arrays]
