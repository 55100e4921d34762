"""Matched modified Kneser-Ney models of word trigrams, counted and scored by middle word.

Trigrams, their contexts (w1, w2), their pairs (w2, w3) and the pairs' context w2 share the
middle word, so the trigrams of all texts are dealt out by it once and packed; a bucket counts
and scores its own.  Only sums beyond a bucket travel besides: how many words stand before
a word, and the contexts of words so frequent that they are dealt out by their third word
too.  A bucket asks the shard that a key belongs to; the shard adds up what all buckets know of it
and answers each in the order of its keys.

* ``survey``: the number of words, and the words that one bucket can't hold.
* ``dealt``: texts -> (bucket, data), each word's trigram with its row, a few bytes each.
* ``summed``: (bucket, data) -> (bucket, shard, data), the sums over all buckets.
* ``scored``: both -> (doc_id, n_chars, n_blank, log0, log1), the documents' log-probabilities, added up in a task
  before they are sent on.

No count is pruned or sampled.  Only the survey reaches the driver, at most SHARE words.
Below the unigrams stands a spelling: ``width`` characters of 63 equally likely symbols,
the same in both models, so the vocabulary is open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import _SPACE, chunks, mix, release, texts_of, trim, word_hashes

SYMBOLS = 63
MODELS = (0, 1)
#: Running words that a task packs at once, and those that a bucket may hold.
GATHER, BUCKET = 5 << 20, 1 << 21
SLICE = 1 << 17
#: A word with less than one SHARE-th of a task's words isn't looked at by the survey.
SHARE = 1 << 13

_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- packed arrays -----------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers that aren't negative, by byte planes: those above the greatest number are left out."""
    codec, heads, parts = pa.Codec("zstd", compression_level=1), [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype=np.uint64)
        planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        heads += [len(x), planes]
        for plane in x.view(np.uint8).reshape(len(x), 8).T[:planes]:
            parts.append(codec.compress(np.ascontiguousarray(plane), asbytes=True))
            heads.append(len(parts[-1]))
    return np.array([len(heads), *heads], dtype=np.uint32).tobytes() + b"".join(parts)


def unpack(data: pa.Buffer) -> list[np.ndarray]:
    codec, at = pa.Codec("zstd"), 4 * (1 + int(np.frombuffer(data, np.uint32, 1)[0]))
    heads = iter(np.frombuffer(data, np.uint32, at // 4)[1:].tolist())
    out = []
    for _ in range(next(heads)):
        n, planes = next(heads), next(heads)
        x = np.zeros((n, 8), dtype=np.uint8)
        for i in range(planes):
            size = next(heads)
            x[:, i] = np.frombuffer(codec.decompress(data.slice(at, size), n), np.uint8)
            at += size
        out.append(x.reshape(-1).view(np.uint64))
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, a place of each and the number of each element's value: ``np.unique`` in
    half its memory."""
    order = np.argsort(x)
    values = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    values, first = values[new], order[new]
    number = np.empty(len(x), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return values, first, number


def _buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[pa.Buffer]:
    return (x.as_buffer() for x in column)


# --- texts -------------------------------------------------------------------


def widths(texts: list[bytes]) -> np.ndarray:
    """Characters of each word, in the order of ``word_hashes``."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACE[flat]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    sums = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
    return (sums[edge[1::2]] - sums[edge[::2]]).astype(np.int32)


@dataclass(frozen=True)
class Plan:
    """Buckets, the tasks that share them and the number that sends each bucket to its task; frequent
    words (ascending) and over how many buckets each is dealt out."""

    buckets: int
    tasks: int
    number: np.ndarray
    hot: np.ndarray
    over: np.ndarray

    @property
    def shards(self) -> int:
        return (self.buckets + 1) // 2

    def spread(self, words: np.ndarray) -> np.ndarray:
        """Over how many buckets each word's trigrams are dealt out."""
        if not len(self.hot):
            return np.ones(len(words), dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, self.over[at], 1).astype(np.uint64)

    def bucket(self, known: np.ndarray, middle: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The bucket of each pair of numbers of known words."""
        over = self.spread(known).astype(np.int64)
        out = (known % np.uint64(self.buckets)).astype(np.int64)[middle]
        some = np.flatnonzero(over[middle] > 1)
        out[some] = (out[some] + (mix(known + _STEP) >> np.uint64(1)).astype(np.int64)[third[some]] % over[middle[some]]) % self.buckets
        return out

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each shard's part of ascending keys begins and ends."""
        shard = ((keys >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        return np.searchsorted(shard, np.arange(self.shards + 1, dtype=np.uint64))


def _numbers(spark: SparkSession, buckets: int, tasks: int) -> np.ndarray:
    """Numbers that a repartition deals out evenly: as they are, some tasks would get several times their share."""
    task = F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks))
    rows = spark.range(64 * buckets).groupBy(task.alias("task")).agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()
    ids = {r["task"]: r["ids"] for r in rows}
    return np.array([ids[b % tasks][b // tasks] for b in range(buckets)], dtype=np.int32)


def survey(texts: list[DataFrame]) -> Plan:
    """Counts the words of one-column tables of texts.  Which words are taken as frequent decides where
    their trigrams are counted, never what is counted."""

    def tally(batches):
        release()
        parts, size, starts = [], 0, 0

        def found():
            word, n = np.unique(np.concatenate(parts), return_counts=True)
            some = n * SHARE >= size
            return pa.record_batch({"word": pa.array([*word[some].view(np.int64).tolist(), 0, None], pa.int64()), "n": pa.array([*n[some].tolist(), starts, size], pa.int64())})

        for b in batches:
            docs = texts_of(b.column(0))
            for i, j in chunks(docs):
                words, bounds = word_hashes(docs[i:j])
                parts.append(words)
                size += len(words)
                starts += int((np.diff(bounds) > 0).sum())
                if size >= GATHER:
                    yield found()
                    parts, size, starts = [], 0, 0
        if size:
            yield found()
        trim()

    every = [t.select(F.col(t.columns[0]).cast("string")).mapInArrow(tally, "word long, n long") for t in texts]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") > BUCKET // 4)).collect()
    total = sum(r["n"] for r in counts if r["word"] is None)
    hot = sorted((r["word"] % (1 << 64), -(-4 * r["n"] // BUCKET)) for r in counts if r["word"] is not None)
    buckets = max(1, -(-total // BUCKET), min(16, -(-16 * total // BUCKET)))
    tasks = min(buckets, max(16, -(-buckets // 12)))
    return Plan(buckets, tasks, _numbers(texts[0].sparkSession, buckets, tasks), np.array([w for w, _ in hot], np.uint64), np.array([min(n, buckets) for _, n in hot], np.uint64))


_GRAMS, _DOCUMENTS = 0, 1


def _words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and widths of all words, and the number of words of each document."""
    parts = []
    for i, j in chunks(docs):
        words, bounds = word_hashes(docs[i:j])
        parts.append((words, widths(docs[i:j]), np.diff(bounds)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _dealt(plan: Plan, words: np.ndarray, width: np.ndarray, counts: np.ndarray, rows: np.ndarray | None, marks: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, data) of some documents' trigrams; 0 stands for the two places before a text.

    Words are numbered by hash, trigrams stand by middle word and row, so that most differences are small.
    """
    known, first, number = distinct(words)
    del words
    known, width = np.concatenate(([np.uint64(0)], known)), np.concatenate(([0], width[first]))
    grams = np.zeros((3, len(number)), dtype=np.int32)
    grams[2] = number + 1
    del number
    grams[1, 1:], grams[0, 2:] = grams[2, :-1], grams[2, :-2]
    ends = np.cumsum(counts)
    grams[:2, (ends - counts)[counts > 0]] = 0
    grams[0, (ends - counts)[counts > 1] + 1] = 0
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    bucket = plan.bucket(known, grams[1], grams[2])
    cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=plan.buckets))))
    order = np.argsort(bucket * len(known) + grams[1], kind="stable")
    del bucket
    local, used = np.empty(len(known), dtype=np.int32), np.zeros(len(known), dtype=bool)
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        own, of = grams[:, at], owner[at]
        used[own] = True
        names = np.flatnonzero(used)
        used[names] = False
        local[names] = np.arange(len(names))
        own = local[own]
        new = np.diff(own[1], prepend=-1) != 0  # the first trigram of a middle word
        place = np.zeros(0) if rows is None else rows[of] - rows[0]
        step = place if rows is None else np.where(new, place, np.diff(place, prepend=0))
        yield int(b), pack([_GRAMS], np.diff(known[names], prepend=np.uint64(0)), width[names], own[0], np.diff(own[1], prepend=0), own[2], marks[of], [] if rows is None else rows[:1], step)


def _about(rows: np.ndarray, ids: pa.Array, docs: list[bytes], width: np.ndarray, counts: np.ndarray) -> bytes:
    """What is known of documents themselves."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    chars = np.fromiter((len(t.decode("utf-8", "surrogatepass")) for t in docs), dtype=np.int64, count=len(docs))
    ends = np.cumsum(counts)
    sums = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    return pack([_DOCUMENTS], rows, null, value, chars, chars - (sums[ends] - sums[ends - counts]))


def dealt(plan: Plan, texts: DataFrame, scored: bool) -> DataFrame:
    """(bucket, data) of texts (row, doc_id, text, mark).  Bit m of a mark says that model m counts the text."""

    def run(batches):
        release()
        parts, size = [], 0

        def packed():
            docs = [t for p in parts for t in p[0]]
            rows = np.concatenate([p[1] for p in parts])
            words, width, counts = _words(docs)
            made = []
            if scored:
                made.append((int(rows[0]) % plan.buckets, _about(rows, pa.concat_arrays([p[2] for p in parts]), docs, width, counts)))
            if len(words):
                made += _dealt(plan, words, width, counts, rows if scored else None, np.concatenate([p[3] for p in parts]))
            return pa.record_batch({"bucket": pa.array([int(plan.number[b]) for b, _ in made], pa.int32()), "data": pa.array([d for _, d in made], pa.binary())})

        for b in batches:
            docs = texts_of(b.column(2))
            for i, j in chunks(docs):
                n = j - i
                parts.append((docs[i:j], b.column(0).slice(i, n).to_numpy(), b.column(1).slice(i, n), b.column(3).slice(i, n).to_numpy()))
                size += sum(t.count(b" ") + t.count(b"\n") + 1 for t in docs[i:j])
                if size >= GATHER:
                    yield packed()
                    parts, size = [], 0
        if parts:
            yield packed()
        trim()

    return texts.select("row", "doc_id", "text", "mark").mapInArrow(run, "bucket int, data binary")


def _places(middle: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Rows of trigrams, counted from the first row of their task, from the differences within each middle word."""
    new = np.flatnonzero(np.diff(middle, prepend=middle[:1] + np.uint64(1)))
    sums = np.cumsum(step)
    return sums - np.repeat(sums[new] - step[new], np.diff(np.append(new, len(step))))


# --- counts of a bucket ------------------------------------------------------


def _tally(of: np.ndarray, n: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
    """For the wanted ones of ``of``: the sum of its counts, and how many of them are 1, 2, more."""
    if not len(wanted):
        return np.zeros((4, 0))
    return np.stack([np.bincount(of, n, size)[wanted], *(np.bincount(of[some], minlength=size)[wanted] for some in (n == 1, n == 2, n > 2))])


def _seen(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4."""
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]


class Counts:
    """Trigrams, contexts and pairs of a bucket, and what it must ask for.

    Grams and pairs are distinct; ``gram_of`` are the grams of all occurrences, blob by
    blob, ``blobs`` (first occurrence, last, row of each) of those to be scored.
    """

    def __init__(self, plan: Plan, column: pa.ChunkedArray) -> None:
        self.documents, self.blobs = [], []
        names, width, grams, marks, n, known = [], [], [], [], 0, 0
        for data in _buffers(column):
            kind, *own = unpack(data)
            if kind[0] == _DOCUMENTS:
                self.documents.append(own)
                continue
            names.append(np.cumsum(own[0], dtype=np.uint64))
            width.append(own[1].astype(np.int32))
            middle = np.cumsum(own[3], dtype=np.uint64)
            grams.append(np.stack([x.astype(np.int32) for x in (own[2], middle, own[4])]) + np.int32(known))
            marks.append(own[5].astype(np.uint8))
            if len(own[6]):
                self.blobs.append((n, n + len(middle), int(own[6][0]), _places(middle, own[7]).astype(np.int64)))
            n, known = n + len(middle), known + len(own[0])
        words, first, inverse = distinct(np.concatenate([*names, np.zeros(0, np.uint64)]))
        width = np.concatenate([*width, np.zeros(0, np.int32)])[first]
        grams = np.concatenate([*grams, np.zeros((3, 0), np.int32)], axis=1)
        marks, d = np.concatenate([*marks, np.zeros(0, np.uint8)]), max(1, len(words))
        trim()
        contexts, _, of = distinct(inverse[grams[0]] * np.int64(d) + inverse[grams[1]])
        last = inverse[grams[2]]
        del grams, inverse
        made, _, self.gram_of = distinct(of * np.int64(d) + last)
        del of, last
        trim()
        small = lambda x: x.astype(np.int32)
        self.n = [small(np.bincount(self.gram_of[(marks >> m & 1).astype(bool)], minlength=len(made))) for m in MODELS]
        self.context, third = small(made // d), small(made % d)
        del made, marks
        self.width, middle = width[third], small(contexts % d)
        pairs, _, self.pair = distinct(middle[self.context] * np.int64(d) + third)
        self.pair_n = [small(np.bincount(self.pair[n > 0], minlength=len(pairs))) for n in self.n]
        self.pair_middle, pair_third = small(pairs // d), small(pairs % d)
        self.sizes = len(contexts), d

        # unigrams: the words that stand third, ascending
        stands = np.zeros(d, dtype=bool)
        stands[pair_third] = True
        thirds = np.flatnonzero(stands)
        self.word = small(np.cumsum(stands) - 1)[pair_third]
        self.word_keys = words[thirds]
        self.word_n = [np.bincount(self.word[n > 0], minlength=len(thirds)) for n in self.pair_n]
        # contexts of words that are dealt out over several buckets, ascending by key
        hot = plan.spread(words) > 1
        self.shared_middle, self.shared_context = np.flatnonzero(hot), np.flatnonzero(hot[middle])
        pair_keys = mix(mix(words[contexts[self.shared_context] // d] + _STEP) * _STEP + words[middle[self.shared_context]])
        keys = np.concatenate((mix(words[self.shared_middle] ^ _STEP), pair_keys))
        self.shared_order = np.argsort(keys)
        self.shared_keys = keys[self.shared_order]

    def shared_sums(self) -> np.ndarray:
        """What this bucket has of contexts that others have too: four rows a model."""
        found = []
        for m in MODELS:
            middles = _tally(self.pair_middle, self.pair_n[m], self.sizes[1], self.shared_middle)
            found.append(np.concatenate((middles, _tally(self.context, self.n[m], self.sizes[0], self.shared_context)), axis=1)[:, self.shared_order])
        return np.concatenate(found)

    def split_shared(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums over all buckets that the shards answer with, of the contexts and of the middle words."""
        own, n = np.empty(shared.shape), len(self.shared_middle)
        own[:, self.shared_order] = shared
        return own[:, n:], own[:, :n]


def summed(plan: Plan, blobs: DataFrame) -> DataFrame:
    """(bucket, shard, data): what the shards answer to each bucket."""

    def ask(group: pa.Table) -> pa.Table:
        c = Counts(plan, group.column("data"))
        orders = [_seen(c.n[-1]), _seen(c.pair_n[-1])]
        words, shared = plan.bounds(c.word_keys), plan.bounds(c.shared_keys)
        sums, made = c.shared_sums(), []
        for s in range(plan.shards):
            a, b = slice(words[s], words[s + 1]), slice(shared[s], shared[s + 1])
            step = lambda keys: np.diff(keys, prepend=np.uint64(0))
            made.append(pack(np.concatenate(orders) if s == 0 else [], step(c.word_keys[a]), *(n[a] for n in c.word_n), step(c.shared_keys[b]), *(x[b] for x in sums)))
        trim()
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"shard": pa.array(range(plan.shards), pa.int32()), "bucket": pa.array([bucket] * plan.shards, pa.int32()), "data": pa.array(made, pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        asked = [unpack(data) for data in _buffers(group.column("data"))]
        orders = sum((x[0].astype(np.int64) for x in asked if len(x[0])), np.zeros(8 if group.column("shard")[0].as_py() == 0 else 0, np.int64))

        def total(at: int, columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            sizes = np.cumsum([0, *(len(x[at]) for x in asked)])
            known, inverse = np.unique(np.concatenate([np.cumsum(x[at], dtype=np.uint64) for x in asked]), return_inverse=True)
            return [np.bincount(inverse, np.concatenate([x[at + 1 + i] for x in asked]), len(known)).astype(np.int64) for i in range(columns)], inverse, sizes

        words, word_of, word_at = total(1, 2)
        shared, shared_of, shared_at = total(4, 8)
        levels = [np.array([n.sum(), (n == 1).sum(), (n == 2).sum(), (n > 2).sum()]) for n in words]
        stats = np.concatenate((orders, _seen(words[-1]), *levels))
        made = []
        for i in range(len(asked)):
            a, b = word_of[word_at[i] : word_at[i + 1]], shared_of[shared_at[i] : shared_at[i + 1]]
            made.append(pack(stats, *(n[a] for n in words), *(x[b] for x in shared)))
        trim()
        return pa.table({"bucket": group.column("bucket"), "shard": group.column("shard"), "data": pa.array(made, pa.binary())})

    asked = blobs.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, data binary")
    return asked.groupBy("shard").applyInArrow(answer, "bucket int, shard int, data binary")


# --- probabilities -----------------------------------------------------------


def discounts(seen: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many counts of the last model are 1, 2, 3, 4 (Chen and Goodman).

    Both models are discounted alike: with discounts of their own, a document that both
    have learned would be told apart by how many copies the rest of their texts hold.
    Where too few distinct counts exist to estimate them, 0.5, 1 and 1.5 stand in.
    """
    n1, n2, n3, n4 = (int(n) for n in seen)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    made = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(made, 1))


def _level(of: np.ndarray, n: np.ndarray, size: int, cuts: tuple[float, float, float], shared: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context's sum of counts, 1 at least, and its back-off weight; ``sums`` holds what is shared with other buckets."""
    of_all, free = np.bincount(of, n, size), np.bincount(of, np.array([0.0, *cuts])[np.minimum(n, 3)], size)
    of_all[shared], free[shared] = sums[0], sums[1] * cuts[0] + sums[2] * cuts[1] + sums[3] * cuts[2]
    some = np.maximum(of_all, 1)
    return some, np.where(of_all > 0, free / some, 1.0)


def _logs(c: Counts, right: pa.Table) -> list[np.ndarray]:
    """log p(w3 | w1 w2) of each of a bucket's trigrams under both models."""
    answers = [unpack(x) for x in _buffers(right.sort_by("shard").column("data"))]
    head = np.concatenate((answers[0][0][:8], sum(x[0][-12:].astype(np.int64) for x in answers))).astype(np.int64)
    got = [np.concatenate([x[i] for x in answers]).astype(np.int64) for i in range(1, 11)]
    shared = np.stack(got[2:])
    threes, twos, ones = (discounts(head[i : i + 4]) for i in (0, 4, 8))
    made = []
    for m in MODELS:
        cut = lambda n, cuts: n - np.array([0.0, *cuts])[np.minimum(n, 3)]
        of_contexts, of_middles = c.split_shared(shared[4 * m : 4 * m + 4])
        total, once, twice, more = head[12 + 4 * m : 16 + 4 * m].tolist()
        seen = cut(got[m], ones) / max(total, 1)
        rest = (once * ones[0] + twice * ones[1] + more * ones[2]) / total if total else 1.0
        some, gamma = _level(c.pair_middle, c.pair_n[m], c.sizes[1], twos, c.shared_middle, of_middles)
        of, rest = c.pair_middle, gamma * rest
        seen = cut(c.pair_n[m], twos) / some[of] + gamma[of] * seen[c.word]
        some, gamma = _level(c.context, c.n[m], c.sizes[0], threes, c.shared_context, of_contexts)
        logs = np.empty(len(c.context))
        for i in range(0, len(logs), SLICE):
            part = slice(i, i + SLICE)
            of, pair = c.context[part], c.pair[part]
            known, left = cut(c.n[m][part], threes) / some[of] + gamma[of] * seen[pair], gamma[of] * rest[c.pair_middle[pair]]
            spelling = -c.width[part] * math.log(SYMBOLS)
            # a long unseen word's spelling is below the least double
            near = known > 0
            logs[part] = np.where(near, np.log(np.where(near, known + left * np.exp(spelling), 1.0)), np.log(np.where(left > 0, left, 1.0)) + spelling)
        made.append(logs)
    return made


#: Documents of which a task holds sums before it sends them on.
HELD = 1 << 22


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what a task's buckets know of the same documents; other rows pass."""
    held, size = {}, 0

    def out():
        bases = list(held)
        data = []
        for base in bases:
            met, sums = held[base]
            places = np.flatnonzero(met)
            data.append(pack([_GRAMS], np.diff(places, prepend=0), *sums[:, places].view(np.uint64)))
        return pa.record_batch({"base": pa.array(bases, pa.int64()), "data": pa.array(data, pa.binary())})

    for b in batches:
        for base, data in zip(b.column(0).to_pylist(), _buffers(b.column(1))):
            kind, *own = unpack(data)
            if kind[0] == _DOCUMENTS:
                yield pa.record_batch({"base": pa.array([base], pa.int64()), "data": pa.array([data.to_pybytes()], pa.binary())})
                continue
            places = np.cumsum(own[0]).astype(np.int64)
            met, sums = held.get(base, (np.zeros(0, dtype=bool), np.zeros((2, 0))))
            if (more := int(places[-1]) + 1 - len(met)) > 0:
                met, sums = np.pad(met, (0, more)), np.pad(sums, ((0, 0), (0, more)))
                held[base], size = (met, sums), size + more
            met[places] = True
            sums[:, places] += np.stack(own[1:]).view(np.float64)
            if size > HELD:
                yield out()
                held, size = {}, 0
    if held:
        yield out()
    trim()


def scored(plan: Plan, blobs: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_blank, log0, log1) of each document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Counts(plan, left.column("data"))
        bases, data = [], []
        if c.blobs:
            logs = _logs(c, right)
        for first, last, base, places in c.blobs:
            own, _, of = distinct(places)
            bases.append(base)
            data.append(pack([_GRAMS], np.diff(own, prepend=0), *(np.bincount(of, log[c.gram_of[first:last]]).view(np.uint64) for log in logs)))
        for rows, *own in c.documents:
            bases.append(int(rows[0]))
            data.append(pack([_DOCUMENTS], *own))
        trim()
        return pa.table({"base": pa.array(bases, pa.int64()), "data": pa.array(data, pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in _buffers(group.column("data"))]
        _, null, ids, chars, blank = next(p for p in parts if p[0][0] == _DOCUMENTS)
        logs = np.zeros((2, len(ids)))
        for kind, *own in parts:
            if kind[0] == _GRAMS:
                logs[:, np.cumsum(own[0]).astype(np.int64)] += np.stack(own[1:]).view(np.float64)
        return pa.table({"doc_id": pa.array(ids.view(np.int64), mask=null.astype(bool)), "n_chars": chars.view(np.int64), "n_blank": blank.view(np.int64), "log0": logs[0], "log1": logs[1]})

    rows = blobs.groupBy("bucket").cogroup(sums.repartition(plan.tasks, "bucket").groupBy("bucket")).applyInArrow(run, "base long, data binary")
    return rows.mapInArrow(_gathered, "base long, data binary").groupBy("base").applyInArrow(finish, "doc_id long, n_chars long, n_blank long, log0 double, log1 double")
