"""LM scoring: cross-entropy difference between a target and a background model.

Both are modified Kneser-Ney models of word trigrams with the same order, smoothing and
spelling of unseen words (``word_ngrams``), one of the target texts, one of all texts.
A document's score is its loss under the target model less that under the background
model: the lower, the more it resembles the target.  The counts of both models cover
every word of their texts; each word is shuffled once, packed, to the bucket that counts its
trigram and scores it too.

Losses are in nats a character, so that they don't depend on how long the words are:
``n_tokens`` counts characters.  White space between words is coded alike by both models,
with 63 equally likely symbols, and drops out of the score.

Defined results: a null or empty text has no tokens, null losses and a null score;
without target texts the target model is uniform over spellings; every input row gives
one row, repeated and null ids included.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import small
from . import word_ngrams as wn
from .bloom import Bloom, positions
from .session import append_columns, prepare

#: So many ids are broadcast (some 100 MB); with more, texts whose id may be among them are shuffled.
IDS = 1 << 21


def texts_of_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the rows whose id is among some ids (doc_id): texts that a Bloom filter
    rules out stay where they lie, the others meet the ids in an exact join; both grow, so neither is broadcast."""
    prepare(docs.sparkSession)
    bloom = Bloom(ids, "doc_id")

    def hits(batches):
        for b in batches:
            yield b.filter(pa.array(bloom.hits(b.column(2)))).select(["doc_id", "text"])

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), positions(key).alias("bits"))
    return rows.mapInArrow(hits, "doc_id long, text string").join(ids.hint("merge"), "doc_id", "left_semi")


def marked(docs: DataFrame, ids: DataFrame, mark: str, id_col: str = "doc_id") -> DataFrame:
    """docs with a boolean column: the row's id is among some ids (doc_id, once each).  Few ids are
    broadcast; of many a Bloom filter rules out texts, which stay where they lie, and the others meet the ids in
    an exact join."""
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("long")
    known = ids.select(F.col("doc_id").alias("_waymark_id"), F.lit(True).alias("_waymark_has"))
    meet = lambda rows, others: rows.join(others, key == F.col("_waymark_id"), "left").withColumn(mark, F.col("_waymark_has").isNotNull()).select(*docs.columns, mark)
    few = small(known, IDS)
    if few is not known:
        return meet(docs, few)
    bloom = Bloom(ids, "doc_id")
    rows = append_columns(docs.withColumn("_waymark_bits", positions(key)), [("_waymark_may", "boolean")], lambda b: [pa.array(bloom.hits(b.column(b.num_columns - 1)))])
    other = rows.where(~F.col("_waymark_may")).withColumn(mark, F.lit(False)).select(*docs.columns, mark)
    return other.unionByName(meet(rows.where("_waymark_may"), known.hint("merge")))


def cross_entropy_difference(docs: DataFrame, target: DataFrame | Column, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), losses in nats a character.

    The target is a table of texts, or a condition on the documents: then each word of theirs is
    read and shuffled once for both models.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string").alias("text")
    mark = lambda of, in_background: (F.coalesce(of, F.lit(False)).cast("int") + F.lit(2 * in_background)).cast("int").alias("mark")
    own = target if isinstance(target, Column) else F.lit(False)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text, mark(own, background is None))
    texts = lambda df, is_target: df.select(F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), text, mark(F.lit(is_target), not is_target))
    others = ([] if isinstance(target, Column) else [texts(target, True)]) + ([] if background is None else [texts(background, False)])
    plan = wn.survey([x.select("text") for x in (named, *others)])
    blobs = wn.dealt(plan, named, True)
    for other in others:
        blobs = blobs.unionByName(wn.dealt(plan, other, False))
    blobs = blobs.repartition(plan.tasks, "bucket")
    rows = wn.scored(plan, blobs, wn.summed(plan, blobs)).withColumnRenamed("n_chars", "n_tokens")
    tokens = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    blank = F.col("n_blank") * math.log(wn.SYMBOLS)
    out = rows.withColumn("target_loss", (blank - F.col("log0")) / tokens).withColumn("background_loss", (blank - F.col("log1")) / tokens)
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
