"""The pipeline: each stage against its operator, and the whole on awkward rows."""

import hashlib

import corpus_pipeline as cp
from pyspark.sql import functions as F

from waymark.llm import minhash_dedup, mixing, quality_lm, toxicity_gbt


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = cp.quality(spark, docs, sf).persist()
    assert names(good) == names(quality_lm.classify(docs, labels).where("kept"))
    mild = cp.toxicity(spark, good, sf).persist()
    assert names(mild) == names(toxicity_gbt.toxicity(good, labels).where("predicted = 0"))
    single = cp.near_duplicates(spark, mild, sf).persist()
    assert names(single) == names(minhash_dedup.near_duplicates(mild).where("kept"))
    mixed = cp.mix(spark, single, sf).persist()
    copies = mixing.mix(single)
    assert mixed.count() == copies.agg(F.sum("copies")).first()[0]
    for df in (good, mild, single, mixed):
        assert df.columns == docs.columns
    tokens = cp.tokens(spark, mixed, sf).collect()
    assert len(tokens) == mixed.count()
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in tokens)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and [name for name, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "tokens"]


def test_awkward(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (4, "same words here again and more", "en", None, 1), (5, "same words here again and more", None, "b", 1), (5, "same words here again and more", None, "b", 1), (None, "an id is missing", "xx", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_lang", F.lit("x")).withColumn("_bits", F.lit("x"))
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            out.collect()
        cp.STAGES[-1][1](spark, df, sf).collect()
