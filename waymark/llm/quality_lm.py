"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The trusted documents are dealt to two halves by a hash of their ids.  A model of each half
scores the other, and a document is rejected if the model of all finds it too far above those
scores in its language and length: beyond the median by more than REACH times the distance from
the median to the 0.9 quantile.  Both are quantiles that some ten scores determine, unlike one
far out in the tail, which is the maximum of a small cell and hangs on one odd text.

The distinct n-grams of some documents, sorted, meet the shards of the finished count table
one after another (``kneser_ney.Scorer``); the shards are broadcast, as at most 2**24
n-grams exist, and no n-gram of a document is shuffled; of the texts those that a Bloom filter of
trusted ids lets pass are, once, as models are counted over every trusted document.

Defined results: a null or empty text has a null perplexity and is rejected; a language of few
trusted documents of a length leans on the quantiles of all (``kneser_ney.quantiles``), a
length without any has those of all lengths; without any trusted text nothing but empty texts is rejected; every input row
gives one row.  A null id is never trusted; ids that repeat are trusted as often as they stand.  Texts
are scored in pieces of a million characters; other columns are kept by ``keep``, where one named
``_waymark_words``, ``_waymark_log`` or ``_waymark_length`` raises, and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .cross_entropy import texts_of_ids
from .session import append_columns, cut, prepare
from .textops import batch, trim, word_count

LEVEL, REACH = 0.9, 3.0


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled as good and never as bad, once each."""
    rows = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    return rows.agg(F.min("quality").alias("worst")).where("worst = 1").select("doc_id")


def _measure(scorer: kn.Scorer, texts: list[str]) -> tuple[list[int], list[float | None]]:
    """Words and log-perplexity (null without characters) of each text."""
    words = [word_count(t.encode("utf-8", "surrogatepass")) for t in texts]
    return words, [-log / len(t) if t else None for t, log in zip(texts, scorer.logs(texts).tolist())]


def half(id_col: str) -> Column:
    """0 or 1 by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("half")), F.lit(2)).cast("int")


class Classifier:
    """A model of trusted text with the thresholds that its halves give each other."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: float = LEVEL, reach: float = REACH) -> None:
        spark = prepare(docs.sparkSession)
        self.columns = (id_col, text_col, lang_col)
        self.docs, self.trusted = docs, cut(trusted_ids(labels))
        text = texts_of_ids(docs, self.trusted, id_col, text_col)  # of every trusted document
        table = kn.count_ngrams(text, "text", half("doc_id")).toArrow()
        part, key, n = (table[c].to_numpy() for c in ("part", "key", "n"))
        del table
        halves = []
        for p in (0, 1):  # one model at a time is on the driver
            halves.append(kn.Scorer(spark, kn.model_of(key[part != p], n[part != p])))
        both, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n, len(both)).astype(np.int64)
        del part, key, at
        self.scorer = kn.Scorer(spark, kn.model_of(both, n))
        # no text moves: all are scored where they lie, then the trusted are told apart
        scored = self._scored(docs, halves).join(self.trusted, "doc_id", "left_semi")
        found = kn.quantiles(scored, "lang", {"log_ppl": {"q50": 0.5, "far": level}})
        self.found = cut(found.withColumn("_waymark_upper", F.col("q50") + reach * (F.col("far") - F.col("q50"))).drop("q50", "far"))
        for scorer in halves:
            scorer.close()

    def _scored(self, docs: DataFrame, scorers: list[kn.Scorer]) -> DataFrame:
        """Words and log-perplexity of each document, by the scorer of its half if there are two."""
        id_col, text_col, lang_col = self.columns
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("log_ppl", pa.float64())])

        def run(batches):
            for b in batches:
                own = b.column(3).to_numpy()
                for p, scorer in enumerate(scorers):
                    mine = b if len(scorers) == 1 else b.filter(pa.array(own == p))
                    words, logs = _measure(scorer, [t or "" for t in mine.column(1).to_pylist()])
                    yield batch({"doc_id": mine.column(0), "lang": mine.column(2), "n_words": words, "log_ppl": logs}, schema)
            trim()

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), half(id_col).alias("half"))
        return rows.mapInArrow(run, "doc_id long, lang string, n_words long, log_ppl double").withColumn("length_class", kn.length_class(F.col("n_words")))

    def verdicts(self) -> DataFrame:
        """(doc_id, lang, n_words, trusted, perplexity, threshold, kept), a row for each document."""
        scored = self._scored(self.docs, [self.scorer]).join(self.trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
        out = kn.with_quantiles(scored.withColumn("trusted", F.coalesce("trusted", F.lit(False))), "lang", self.found, ["_waymark_upper"])
        return out.select("doc_id", "lang", "n_words", "trusted", F.exp("log_ppl").alias("perplexity"), F.exp("_waymark_upper").alias("threshold"), self._good("log_ppl").alias("kept"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that pass, decided row by row where they lie."""
        _, text_col, lang_col = self.columns
        scorer = self.scorer

        def made(b):
            words, logs = _measure(scorer, [t or "" for t in b.column(text_col).to_pylist()])
            return [pa.array(words, pa.int64()), pa.array(logs, pa.float64())]

        rows = append_columns(docs, [("_waymark_words", "long"), ("_waymark_log", "double")], made)
        rows = kn.with_quantiles(rows.withColumn("_waymark_length", kn.length_class(F.col("_waymark_words"))), lang_col, self.found, ["_waymark_upper"], "_waymark_length")
        return rows.where(self._good("_waymark_log")).select(*docs.columns)

    @staticmethod
    def _good(value: str):
        return F.coalesce(F.col(value) <= F.coalesce(F.col("_waymark_upper"), F.lit(float("inf"))), F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: perplexity, threshold and whether it is kept."""
    return Classifier(docs, labels, id_col, text_col, lang_col).verdicts()
