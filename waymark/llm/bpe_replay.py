"""Byte-level BPE encoding and decoding by replaying the merges over blocks of the corpus.

A worker gathers the distinct pieces (pattern matches) of a batch that it hasn't met
yet, lays their bytes out as one linked list of tokens and builds an inverted index
from each mergeable pair to the positions that hold it.  The merges then run once, in
rank order, each over all positions of its pair; only the two neighbours of a merged
position get a new pair, which joins the index.  Texts are sequences of pieces, so
their ids are gathered from the pieces' ids.

Defined results: a null or empty text has no ids and decodes to no bytes; special
tokens in a text are ordinary text; every input row gives one row.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare
from .textops import cached, trim

NONE = np.int32(1 << 30)
#: Pieces whose ids a worker remembers between batches: bounds its memory, not its results.
MEMORY = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


class Vocabulary:
    """Ranked tokens, the pairs that merge into each, and the bytes of all in one array."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.pattern = pattern
        rank = {t: i for i, t in enumerate(tokens)}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = sorted((rank[t[:i]] << 32 | rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank)
        self.pairs = np.array([p for p, _ in pairs] or [-1], dtype=np.int64)
        self.merged = np.array([r for _, r in pairs] or [NONE], dtype=np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges into, NONE if it doesn't."""
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.merged[at], NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.bytes, self.starts[ids], self.lengths[ids])


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length]."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, number of ids of each piece)."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    token = vocabulary.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(token)
    if not n:
        return token, lengths
    ends = np.cumsum(lengths) - 1
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends[lengths > 0]] = -1
    before[(ends - lengths + 1)[lengths > 0]] = -1
    rank = np.full(n, NONE, dtype=np.int32)  # of the pair that begins at a position
    inner = np.flatnonzero(after >= 0)
    rank[inner] = vocabulary.ranks(token[inner], token[inner + 1])

    listed = np.zeros(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(positions: np.ndarray) -> None:
        found = rank[positions]
        positions, found = positions[found != NONE], found[found != NONE]
        if not len(found):
            return
        order = np.argsort(found, kind="stable")
        positions, found = positions[order], found[order]
        at = np.flatnonzero(found[1:] != found[:-1]) + 1
        for r, part in zip(found[np.concatenate(([0], at))].tolist(), np.split(positions, at)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(queue, r)

    enter(inner)
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == r]  # the others changed since they were entered
        if not len(at):
            continue
        if len(at) > 1:  # the same position may have been entered twice
            at = np.sort(at)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        right = after[at]
        listed[at] = True
        clash = listed[right]
        listed[at] = False
        if clash.any():
            at = at[_leftmost(at, right, clash)]
            right = after[at]
        beyond = after[right]
        token[at], token[right] = r, -1
        rank[right] = NONE
        after[at] = beyond
        more = beyond >= 0
        before[beyond[more]] = at[more]
        rank[at] = NONE
        rank[at[more]] = vocabulary.ranks(token[at[more]], token[beyond[more]])
        left = before[at]
        left = left[left >= 0]
        rank[left] = vocabulary.ranks(token[left], token[after[left]])
        enter(np.concatenate((at[more], left)))
    alive = token >= 0
    sums = np.concatenate(([0], np.cumsum(alive)))
    return token[alive], sums[ends + 1] - sums[ends - lengths + 1]


def _leftmost(at: np.ndarray, right: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (x x x) keep the first, third, ... from the left."""
    keep = np.ones(len(at), dtype=bool)
    where = {p: i for i, p in enumerate(at.tolist())}
    for i in np.flatnonzero(clash).tolist():
        if keep[i]:
            keep[where[int(right[i])]] = False
    return keep


class Encoder:
    """Encodes batches of texts; remembers up to MEMORY pieces between them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.findall = regex.compile(vocabulary.pattern).findall
        self.reset()

    def reset(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text's)."""
        if len(self.number) > MEMORY:
            self.reset()
        known = len(self.number)
        split = [np.fromiter(map(self.number.__getitem__, self.findall(t)), dtype=np.int64) for t in texts]
        new = [p.encode("utf-8", "surrogatepass") for p in islice(self.number, known, None)]
        ids, counts = replay(new, self.vocabulary)
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        used = np.concatenate(split) if split else np.empty(0, np.int64)
        lengths = self.counts[used]
        starts = np.cumsum(self.counts) - self.counts
        sums = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in split]))).astype(np.int64)
        return _gather(self.ids, starts[used], lengths), sums[bounds]


def parts(texts: list[str], limit: int = 1 << 20):
    """Ranges of texts of about ``limit`` characters; bounds what a worker holds at once."""
    first = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) and, if asked for, the bytes that the ids decode to.

    The vocabulary is broadcast: its file's size bounds it, whatever the corpus.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    name = f"{ranks_path}\0{pattern}"

    def run(batches):
        encoder = cached(name, lambda: Encoder(Vocabulary(*shared.value)))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in parts(texts):
                ids, bounds = encoder.encode(texts[i:j])
                arrays = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                names = ["doc_id", "ids"]
                if decoded:
                    arrays.append(_binary(encoder.vocabulary, ids, bounds))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(arrays, names)
        trim()

    schema = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _binary(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = vocabulary.decode(ids)
    ends = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of rows with ids; null ids decode to no bytes."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        vocabulary = Vocabulary(shared.value, "")
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            ids = np.array([i for x in lists for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(vocabulary, ids, bounds)], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Number of ids and SHA-256 of the ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
