"""The corpus pipeline: five operators of ``waymark.llm`` in a row over ``documents``.

Each stage works on all that the one before has kept.  A stage before the last returns
rows with the columns of documents; ``run`` applies them to the documents of a folder.
The first two stages and the mixing decide row by row.  For near copies rows that share a
doc_id are one document, kept together; those without an id link with nothing and stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.checkpoints import remove, scratch
from waymark.llm import bpe_replay, minhash_dedup, mixing, quality_lm, toxicity_gbt
from waymark.llm.session import write_out


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects, row by row: no text is shuffled."""
    return quality_lm.Classifier(docs, _labels(spark, sf_dir)).keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is predicted toxic, row by row: no text is shuffled."""
    return toxicity_gbt.keep_harmless(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near copies (five-word shingles, 0.8; operator 9's
    own query takes the four words that its contract names)."""
    return minhash_dedup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source meets its target."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes they decode to."""
    encoded = bpe_replay.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return bpe_replay.digests(encoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: Trained models and minhashes have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared folder,
    and then what it was made of is deleted there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = write_out(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
