"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, chat_repair, cross_entropy, fill_middle, itq_dedup, license_scan, merkle, minhash_dedup, mixing, ngram_rules, quality_lm, simhash, toxicity_gbt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op2_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.link(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = quality_lm.trusted_ids(table(spark, sf_dir, "labels"))
    return cross_entropy.cross_entropy_difference(cross_entropy.marked(docs.select("doc_id", "text"), trusted, "trusted"), F.col("trusted"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_replay.digests(bpe_replay.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.likeness(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_repair, op2_ngram_rules, op3_quality_classifier, op4_mixing, op5_itq_dedup, op6_license_scan, op7_toxicity, op8_cross_entropy, op9_minhash_dedup, op10_byte_bpe, op11_merkle_manifest, op12_simhash, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE_SQL, "op5_itq_dedup": itq_dedup.ORACLE_SQL, "op9_minhash_dedup": minhash_dedup.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op13_fill_middle": fill_middle.ORACLE_SQL}
