"""Quality rules: counts of a text, and bands on its n-gram perplexity.

The modified Kneser-Ney model is counted over every text of the input and kept as sorted
arrays of n-gram hashes.  A text's perplexity is that of a word with a letter or digit, so
that odd spelling and anything put between words raise it, and monotonous wording lowers
it.  A text passes if its log-perplexity lies within the band of its language and length, of the
texts there that pass the base rules: Tukey's outer fences, with half the interquartile range
taken on either side for itself, [q25 - 6 (q50 - q25), q75 + 6 (q75 - q50)], so that the longer
upper tail doesn't push the lower limit out of reach.

Defined results: a null or empty text has no words, fails the base rules and has a
null perplexity; a text without a letter or digit has none either and isn't kept; a null language is a language of its own; a language of few
texts of a length leans on the bands of all languages (``kneser_ney.quantiles``); every input row gives
one row, repeated ids included; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .session import cut, prepare
from .textops import batch

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
FENCE = 6.0


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


#: ASCII characters that are neither letters, digits nor white space.
_MARKS = bytes(i for i in range(128) if not chr(i).isalnum() and chr(i) not in BLANKS)


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and words with a letter or
    digit of a text; a character beyond ASCII counts as a letter."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated_lines(raw), repeated_words(words), len(raw.translate(None, _MARKS).split())


_SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_plain long, log_prob double"


def score(docs: DataFrame, scorer: kn.Scorer, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_plain")), ("log_prob", pa.float64())])

    def measure(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [measures(t) for t in texts]
            made = dict(zip(schema.names[2:8], zip(*rows))) if rows else {n: [] for n in schema.names[2:8]}
            yield batch(made | {"doc_id": b.column(0), "lang": b.column(2), "log_prob": scorer.logs(texts)}, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(measure, _SCORED)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: its counts, perplexity, band and verdict."""
    spark = prepare(docs.sparkSession)
    scorer = kn.Scorer(spark, kn.fit(kn.count_ngrams(docs, text_col)))
    scored = score(docs, scorer, id_col, text_col, lang_col)
    scored = scored.withColumn("log_ppl", F.when(F.col("n_plain") > 0, -F.col("log_prob") / F.col("n_plain")))
    scored = cut(scored.withColumn("length_class", kn.length_class(F.col("n_words"))))
    scorer.close()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    found = kn.quantiles(scored.where(~failed), "lang", {"log_ppl": {"q25": 0.25, "q50": 0.5, "q75": 0.75}})
    lower, upper = F.col("q25") - FENCE * (F.col("q50") - F.col("q25")), F.col("q75") + FENCE * (F.col("q75") - F.col("q50"))
    found = cut(found.withColumn("lower", lower).withColumn("upper", upper))
    out = kn.with_quantiles(scored, "lang", found, ["lower", "upper"])
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("lower").alias("lower_perplexity"), F.exp("upper").alias("upper_perplexity"))
