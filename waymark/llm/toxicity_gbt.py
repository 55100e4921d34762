"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, how near they are to second-person
pronouns, capitals, punctuation and obfuscated words.  The lexicon is learned: hashes
of words and of word beginnings (of a few lengths in bytes, so a beginning may end within a
character) that labelled toxic texts have far more often.  Spark counts every term of every
labelled text; all that pass a likelihood-ratio test at LEAST_SURPRISE enter the lexicon.

Labels are read only of rows whose crc32(id as text) mod 5 is not 0.  Trees, lexicon
and calibration are fitted to at most MAX_LABELLED of them, those of least hash of id;
their ids, features and lexicon terms are all that reaches the driver.  A training row's
features come from the lexicon of the other half of the rows, and calibration uses
out-of-fold scores.

Defined results: a null or empty text has features 0 and is scored like any other; a
null id counts as the text ''; without labels of both classes every score is the share
of label 1 (0.0 without labels); an id with several labels takes the largest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import append_columns, cut, prepare
from .textops import _LOWER, _SPACE, chunks, mix, powers, release, texts_of

FOLDS = 5
MAX_LABELLED = 20_000
#: Distinct terms of one half and label that a task gathers before it sends them on.
GATHER = 1 << 20
#: Least log-odds, and least likelihood ratio statistic, of a term in a lexicon.
LEAST_ODDS, LEAST_SURPRISE = 2.0, 10.8
PREFIXES = (4, 5, 6, 7, 8)
#: Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú tu ti tus usted ustedes vosotros".split()
#: Digits and symbols that stand for letters, by byte.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b"013457@$")] = list(b"oieastas")
NAMES = ("hits", "hit_weight", "top_weight", "hit_share", "second_person", "proximity", "capitals", "all_caps", "exclaims", "questions", "punctuation", "symbols", "digits", "obfuscated", "hidden_hits", "log_words", "word_length")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _hash(words: list[bytes]) -> np.ndarray:
    base, _ = powers(64)
    return mix(np.array([(np.frombuffer(w, np.uint8).astype(np.uint64) + np.uint64(1)) @ base[: len(w)] for w in words], dtype=np.uint64))


_PRONOUNS = np.sort(_hash([w.encode() for w in dict.fromkeys(SECOND_PERSON)]))


class Words:
    """The letter runs of a chunk of texts: hashes, lengths and owners."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.lower = _LOWER[self.raw]
        latin = np.flatnonzero((self.raw[:-1] == 0xC3) & (self.raw[1:] >= 0x80) & (self.raw[1:] <= 0x9E) & (self.raw[1:] != 0x97)) + 1
        self.lower[latin] += 32  # the capitals of Latin-1
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=self.n)
        self.ends = np.cumsum(lengths)
        inside = np.concatenate(([False], _LETTER[self.lower]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        self.owner = np.searchsorted(self.ends, self.start, side="right")
        base, self.inverse = powers(len(self.raw) + 1)
        self.sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * base[: len(self.raw)], out=self.sums[1:])
        self.words = mix((self.sums[self.stop] - self.sums[self.start]) * self.inverse[self.start])

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word of more than k bytes, hash of its first k)."""
        at = np.flatnonzero(self.stop - self.start > k)
        start = self.start[at]
        return at, mix((self.sums[start + k] - self.sums[start]) * self.inverse[start]) ^ np.uint64(k)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """(owner, term) of each distinct term of each text."""
        owner, term = [self.owner], [self.words]
        for k in PREFIXES:
            at, hashes = self.prefixes(k)
            owner.append(self.owner[at])
            term.append(hashes)
        both = np.unique(np.rec.fromarrays([np.concatenate(owner), np.concatenate(term)]))
        return both["f0"], both["f1"]


def _weights(hashes: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, values = lexicon
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], 0.0)


def _obfuscated(words: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words with digits or symbols between letters; those of them that are in
    the lexicon once these are read as letters or left out.  Each is read up to its blank."""
    count, hidden = np.zeros(words.n), np.zeros(words.n)
    gap = words.start[1:] - words.stop[:-1]
    near = np.flatnonzero((gap > 0) & (gap <= 3) & (words.owner[1:] == words.owner[:-1]))
    if not len(near):
        return count, hidden
    blank = np.concatenate(([0], np.cumsum(_SPACE[words.lower] | (words.lower == 45) | (words.lower == 39))))
    near = near[blank[words.start[near + 1]] == blank[words.stop[near]]]
    first = near[np.concatenate(([True], near[1:] != near[:-1] + 1))] if len(near) else near
    if not len(first):
        return count, hidden
    blanks = np.concatenate(([-1], np.flatnonzero(_SPACE[words.lower])))
    at = np.searchsorted(blanks, words.start[first])
    end = blanks[at]  # the chunk ends with a line feed
    begin = np.maximum(blanks[at - 1] + 1, np.where(first > 0, words.stop[first - 1], 0))  # with what stands right before
    owner = words.owner[first]
    count += np.bincount(owner, minlength=words.n)
    for read in (_PLAIN[words.lower], words.lower):
        kept = _LETTER[read]
        letters, at = read[kept], np.concatenate(([0], np.cumsum(kept)))
        base, inverse = powers(len(letters) + 1)
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * base[: len(letters)], out=sums[1:])
        hit = _weights(mix((sums[at[end]] - sums[at[begin]]) * inverse[at[begin]]), lexicon) > 0
        hidden += np.bincount(owner, weights=hit, minlength=words.n)
    return count, hidden


def features(texts: list[bytes], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = Words(texts)
    weight = _weights(w.words, lexicon)
    for k in PREFIXES:
        at, hashes = w.prefixes(k)
        weight[at] = np.maximum(weight[at], _weights(hashes, lexicon))
    count = lambda mask, owner=w.owner, values=None: np.bincount(owner[mask], weights=None if values is None else values[mask], minlength=w.n).astype(float)
    n = np.maximum(count(slice(None)), 1.0)
    hit = weight > 0
    hits = count(hit)
    top = np.zeros(w.n)
    np.maximum.at(top, w.owner[hit], weight[hit])
    at = np.minimum(np.searchsorted(_PRONOUNS, w.words), len(_PRONOUNS) - 1)
    person = _PRONOUNS[at] == w.words
    proximity = np.zeros(w.n)
    said, meant = np.flatnonzero(hit), np.flatnonzero(person)
    if len(said) and len(meant):
        right = np.minimum(np.searchsorted(meant, said), len(meant) - 1)
        for other in (meant[right], meant[np.maximum(right - 1, 0)]):
            near = np.where(w.owner[other] == w.owner[said], np.exp(-np.abs(other - said) / 5.0), 0.0)
            np.maximum.at(proximity, w.owner[said], near)
    place = np.searchsorted(w.ends, np.arange(len(w.raw)), side="right")
    by_char = lambda mask: np.bincount(place[mask], minlength=w.n).astype(float)
    capital = (w.raw >= 65) & (w.raw <= 90)
    caps = np.concatenate(([0], np.cumsum(capital)))
    length = w.stop - w.start
    loud = (length > 1) & (caps[w.stop] - caps[w.start] == length)
    size = np.maximum(np.diff(np.concatenate(([0], w.ends))) - 1.0, 1.0)
    letters = np.maximum(count(slice(None), values=length.astype(float)), 1.0)
    is_in = lambda chars: np.isin(w.raw, np.frombuffer(chars, np.uint8))
    odd, hidden = _obfuscated(w, lexicon)
    return np.column_stack((
        hits, count(hit, values=weight), top, 100 * hits / n, 100 * count(person) / n, proximity, by_char(capital) / letters, count(loud) / n,
        by_char(w.raw == 33) / n, by_char(w.raw == 63) / n, by_char(is_in(b".,;:!?")) / n, by_char(is_in(b"#*$%&|<>@_~^")) / size, by_char(is_in(b"0123456789")) / size,
        odd / n, hidden, np.log1p(n), letters / n,
    ))


@dataclass
class Trees:
    """A boosted ensemble of complete trees of one depth, in arrays."""

    base: float = 0.0
    depth: int = 4
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
        """Logistic loss, second order, histograms over quantile bins."""
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        rate_of_one = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = math.log(rate_of_one / (1 - rate_of_one))
        total = np.full(len(y), self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, threshold, split = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for j, e in enumerate(edges):
                    slot = (node - first) * bins + code[:, j]
                    gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                    gain[(hs < least) | (ha - hs < least)] = -1
                    gain[:, len(e) :] = -1
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[better, at[better]]
                    where = first + np.flatnonzero(better)
                    feature[where], split[where], threshold[where] = j, at[better], e[at[better]] if len(e) else np.inf
                node = 2 * node + 1 + (code[np.arange(len(y)), feature[node]] > split[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
            total += value[leaf]
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.value.append(value)
        return self


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated values) to interpolate between.  Rows of
    one score are pooled first."""
    points, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum, rows, least and greatest score
    for s, v, n in zip(points.tolist(), np.bincount(at, y, len(points)).tolist(), np.bincount(at, minlength=len(points)).tolist()):
        blocks.append([v, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], high]
    xs = [x for b in blocks for x in b[2:4]]
    return np.array(xs), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: Trees
    curve: tuple[np.ndarray, np.ndarray]
    constant: float | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = self.trees.raw(features(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.curve), 0.0, 1.0)


def fold(column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _evidence(sides: tuple[int, ...], sizes: dict[int, list[int]]) -> tuple[Column, Column]:
    """(log-odds, likelihood ratio statistic) of a term in some halves of the training rows."""
    toxic, other = (float(sum(sizes[s][k] for s in sides)) for k in (1, 0))
    total = lambda name: sum((F.col(f"{name}{s}") for s in sides), F.lit(0.0))
    a, b = total("toxic"), total("other")
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (other + 1))
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((a + b) * of / (toxic + other)))).otherwise(0.0)
    return odds, 2 * (part(a, toxic) + part(b, other))


def _terms(rows: DataFrame) -> DataFrame:
    """(term, toxic0, other0, toxic1, other1): texts of each label and half that have a term."""

    def count(batches):
        release()
        found: dict[int, list] = {}

        def merged(g):
            term, n = np.concatenate([t for t, _ in found[g]]), np.concatenate([n for _, n in found[g]])
            order = np.argsort(term, kind="stable")
            term, n = term[order], n[order]
            at = np.flatnonzero(np.concatenate(([len(term) > 0], term[1:] != term[:-1])))
            found[g] = [(term[at], np.add.reduceat(n, at) if len(at) else n)]
            return found[g][0]

        def sent(g):
            term, n = merged(g)
            for i in range(0, len(term), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(term[part].view(np.int64)), pa.array(np.full(len(term[part]), g, np.int32)), pa.array(n[part])], ["term", "side", "n"])
            found[g] = []

        for b in batches:
            texts, group = texts_of(b.column(0)), b.column(1).to_numpy()
            for i, j in chunks(texts):
                owner, term = Words(texts[i:j]).terms()
                for g in np.unique(group[i:j]).tolist():
                    own = term[group[i:j][owner] == g]
                    found.setdefault(g, []).append(np.unique(own, return_counts=True))
                    if sum(len(t) for t, _ in found[g]) > GATHER and len(merged(g)[0]) > GATHER // 2:
                        yield from sent(g)
        for g in list(found):
            if found[g]:
                yield from sent(g)

    each = rows.select("text", (F.col("half") * 2 + F.col("toxic")).cast("int").alias("side")).mapInArrow(count, "term long, side int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("side") == 2 * half + toxic, F.col("n"))), F.lit(0)).alias(f"{name}{half}") for half in (0, 1) for toxic, name in ((0, "other"), (1, "toxic"))]
    return each.groupBy("term").agg(*sums)


def lexicons(rows: DataFrame, sizes: dict[int, list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted terms and their log-odds: the lexicons of both halves together and of each."""
    counted, kept = _terms(rows), []
    for name, sides in enumerate(((0, 1), (0,), (1,))):
        odds, surprise = _evidence(sides, sizes)
        some = (sum(sizes[s][1] for s in sides) > 0) and (sum(sizes[s][0] for s in sides) > 0)
        kept.append(F.when((odds >= LEAST_ODDS) & (surprise >= LEAST_SURPRISE) & F.lit(some), odds).alias(f"odds{name}"))
    found = counted.select("term", *kept).where("odds0 is not null or odds1 is not null or odds2 is not null").toArrow()
    term = found["term"].to_numpy().view(np.uint64)
    out = []
    for name in range(3):
        odds = found[f"odds{name}"].to_numpy()
        at = np.flatnonzero(~np.isnan(odds))
        at = at[np.argsort(term[at])]
        out.append((term[at], odds[at]))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(fold(F.col(id_col)) != 0)
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = named.join(F.broadcast(chosen), "_id").withColumn("fold", fold(F.col("_id")).cast("int")).withColumn("half", (F.col("fold") > 2).cast("int"))
    rows = cut(rows, 1_000)  # texts
    sizes = {0: [0, 0], 1: [0, 0]}
    for r in rows.groupBy("half", "toxic").count().collect():
        sizes[r["half"]][r["toxic"]] = r["count"]
    toxic, other = (sizes[0][k] + sizes[1][k] for k in (1, 0))
    if not toxic or not other:
        return Model((np.empty(0, np.uint64), np.empty(0)), Trees(), (np.zeros(1), np.zeros(1)), float(toxic > 0))
    whole, *halves = lexicons(rows, sizes)
    shared = spark.sparkContext.broadcast(halves)

    def measure(batches):
        release()
        for b in batches:
            texts, half = texts_of(b.column(1)), b.column(2).to_numpy()
            for i, j in chunks(texts):
                made = [features(texts[i:j], shared.value[1 - side]) for side in (0, 1)]
                x = np.where(half[i:j, None] == 1, made[1], made[0])
                ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(3).slice(i, j - i), b.column(4).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], ["_id", "toxic", "fold", "x"])

    table = rows.select("_id", "text", "half", "toxic", "fold").mapInArrow(measure, "_id long, toxic int, fold int, x array<double>").toArrow()
    shared.destroy()
    order = np.lexsort((table["toxic"].to_numpy(), table["_id"].to_numpy()))
    x = np.array(table["x"].combine_chunks().flatten()).reshape(-1, len(NAMES))[order]
    y, folds = table["toxic"].to_numpy()[order].astype(float), table["fold"].to_numpy()[order]
    out = np.zeros(len(y))
    for k in range(1, FOLDS):
        mine = folds == k
        if mine.any() and 0 < y[~mine].sum() < (~mine).sum():
            out[mine] = Trees().fit(x[~mine], y[~mine]).raw(x[mine])
    return Model(whole, Trees().fit(x, y), isotonic(out, y))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_score(rows, train(docs, labels, id_col, text_col, label_col)).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_waymark_toxicity").alias("score"), (F.col("_waymark_toxicity") >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column _waymark_toxicity."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def made(b):
        release()
        texts = texts_of(b.column(text_col))
        return [pa.array(np.concatenate([np.empty(0), *(shared.value.score(texts[i:j]) for i, j in chunks(texts))]))]

    return append_columns(docs, [("_waymark_toxicity", "double")], made)


def keep_harmless(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs with a score under 0.5, decided where they lie."""
    scored = with_score(docs, train(docs, labels, id_col, text_col, label_col), text_col)
    return scored.where("_waymark_toxicity < 0.5").select(*docs.columns)
