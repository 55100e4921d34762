"""SimHash fingerprints and the search of those within a Hamming radius.

The terms of a text are its words and its pairs of neighbouring words, A to Z in lower case.  A
term weighs 1 plus the whole part of log2 of how often it occurs; the BITS bits of its hash
vote with that weight for or against each bit of the fingerprint, and a bit is set if more
weight votes for it than against.  Weights and sums are integers, so a fingerprint depends on the text alone.

*Search.*  A fingerprint is cut into radius + ``agree`` blocks.  Two that differ in at most
``radius`` bits agree in ``agree`` whole blocks, so there is one table for each choice of
blocks, keyed by them: no link is lost.  By default a radius of 7 bits needs 8 tables of 32-bit
blocks.  Equal fingerprints are one class before anything is compared; a bucket of many
classes is dealt over tiles, whose rows are counted against each other without making pairs;
a pair counts in the first table that it shares.

*Edits.*  ``edited`` sets each document beside the one after it in the order of ids: texts are moved
once, by ranges of (id, hash of text), and walked in that order; the last row of each range
meets the first of the next afterwards.

Defined results: a null text is taken as empty; texts without words have the fingerprint of no
votes, all zero; a null id comes first in the order; rows that repeat an id follow each other in order of
a hash of their texts; equal rows are interchangeable; the only row of a table is its own
successor; an empty table gives no rows.  Very long texts are hashed in one piece, in one task.
Columns of the input other than id and text are ignored by ``edited`` and ``near`` and kept
by ``fingerprints``, which raises if one is named ``fingerprint``.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable
from .session import append_columns, cut, prepare
from .textops import chunks, mix, shingle_hashes, texts_of, word_hashes

BITS, WORDS = 256, 4
RADIUS = 7
#: Rows of one side of a tile, and the size up to which buckets are compared together.
TILE, LITTLE = 1024, 8
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and neighbouring pairs of each text, text by text, and their bounds."""
    words, at = word_hashes(texts, lower=True)
    pairs, to = shingle_hashes(words, at, 2)
    owner = np.concatenate((np.repeat(np.arange(len(texts)), np.diff(at)), np.repeat(np.arange(len(texts)), np.diff(to))))
    order = np.argsort(owner, kind="stable")
    return np.concatenate((words, pairs))[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of some terms have each of the BITS bits set."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        wide = mix(hashes[i : i + (1 << 14), None] ^ _SEEDS)
        total += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return total


def simhash(texts: list[bytes]) -> list[bytes]:
    """The fingerprint of each text."""
    out = []
    for first, last in chunks(texts):
        hashes, bounds = _terms(texts[first:last])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            terms, often = np.unique(hashes[lo:hi], return_counts=True)
            score, weight, layer = np.zeros(BITS, dtype=np.int64), 0, 1
            while len(terms):  # terms that occur once, those twice or more, four times or more ...
                score += _votes(terms)
                weight += len(terms)
                layer *= 2
                terms, often = terms[often >= layer], often[often >= layer]
            out.append(np.packbits(2 * score > weight).tobytes())
    return out


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distances of fingerprints, one by one."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint64).reshape(-1, WORDS) for s in (a, b))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column fingerprint (64 hexadecimal digits)."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    return append_columns(docs, [("fingerprint", "string")], lambda b: [pa.array([f.hex() for f in simhash(texts_of(b.column(at)))], pa.string())])


# --- the document after it ----------------------------------------------------

#: kind 0: a finished row; 1: the first row of a range; 2: its last one, whose successor is elsewhere.
WALKED = "kind int, part int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited binary, bits_edited int, bits_next int, text string"


def edit(text: str, after: str) -> str:
    """text, its last half of code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(ids: list, texts: list[str], prints: list[bytes], after: list[str], nexts: list[bytes]) -> list[list]:
    made = [edit(t, a).encode() for t, a in zip(texts, after)]
    n, edits = len(ids), simhash(made)
    return [[0] * n, [0] * n, ids, [len(t) for t in texts], [hashlib.sha256(t).digest() for t in made], prints, edits, differing(prints, edits), differing(prints, nexts), [None] * n]


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], [f.split()[0] for f in WALKED.split(", ")])


def _walk(batches):
    """Each row of a sorted range beside the next; (doc_id, text, part) in."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        ids, texts, part = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], b.column(2)[0].as_py()
        prints = simhash([t.encode() for t in texts])
        if held is None:
            yield _batch([[1], [part], [ids[0]], [len(texts[0])], [None], [prints[0]], [None], [None], [None], [texts[0]]])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        yield _batch(_compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]))
        held = ids[-1], texts[-1], prints[-1], part
    if held:
        yield _batch([[2], [held[3]], [held[0]], [len(held[1])], [None], [held[2]], [None], [None], [None], [held[1]]])


def _meet(batches):
    """Last rows of ranges beside the first rows of the next: (doc_id, text, fingerprint, text, fingerprint) in."""
    for b in batches:
        ids, texts, prints, after, nexts = (c.to_pylist() for c in b.columns)
        yield _batch(_compared(ids, texts, prints, after, nexts))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited, bits_edited, bits_next), a row for each
    row of docs: digest of the edited text, fingerprints of the text and of the edited one (all
    binary), and in how many bits the first differs from the second and from the next document's."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("salt"))
    parts = rows.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("part"))
    walked = reliable(parts.mapInArrow(_walk, WALKED))
    ends = walked.where("kind > 0").select("kind", "part", "doc_id", "text", "fingerprint")
    chain = ends.where("kind = 2").select("part")  # a row a range
    chain = chain.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    heads = ends.where("kind = 1").select(F.col("part").alias("to"), F.col("text").alias("after"), F.col("fingerprint").alias("next"))
    pairs = ends.where("kind = 2").join(chain, "part").join(heads, "to").select("doc_id", "text", "fingerprint", "after", "next")
    return walked.where("kind = 0").unionByName(pairs.mapInArrow(_meet, WALKED)).drop("kind", "part", "text")


# --- the search -----------------------------------------------------------------


def tables(radius: int, agree: int = 1) -> list[list[tuple[int, int]]]:
    """The blocks (first bit, last bit) that key each table."""
    n = radius + agree
    edges = [i * BITS // n for i in range(n + 1)]
    return [list(c) for c in combinations(list(zip(edges[:-1], edges[1:])), agree)]


def _masks(radius: int, agree: int) -> np.ndarray:
    """The bits of each table's key, as words of a fingerprint."""
    out = np.zeros((len(tables(radius, agree)), BITS), dtype=np.uint8)
    for row, blocks in zip(out, tables(radius, agree)):
        for lo, hi in blocks:
            row[lo:hi] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def _placed(radius: int, agree: int):
    """(bucket, table, words of the fingerprint): a row for each table."""
    masks = _masks(radius, agree)

    def run(batches):
        for b in batches:
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
            for t, mask in enumerate(masks):
                keys = mix((mix((words & mask) ^ _SEEDS) * (_SEEDS | np.uint64(1))).sum(axis=1, dtype=np.uint64) + np.uint64(t))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(words), t, np.int32)), *(pa.array(words[:, k].copy().view(np.int64)) for k in range(WORDS))], ["key", "table", *(f"w{k}" for k in range(WORDS))])

    return run


def _whole_buckets(batches):
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[0].column(0)[0].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _count(radius: int, agree: int):
    """Of tiles the rows with the number of others within the radius, first met in this table."""
    masks = _masks(radius, agree)

    def linked(x: np.ndarray, y: np.ndarray, table: int | np.ndarray) -> np.ndarray:
        apart = [x[..., k] ^ y[..., k] for k in range(WORDS)]
        near = sum(np.bitwise_count(a).astype(np.int16) for a in apart) <= radius
        near &= np.bitwise_or.reduce([apart[k] & masks[table][..., k] for k in range(WORDS)]) == 0
        for t in range(int(np.max(table)) if np.size(table) else 0):
            met = np.zeros(near.shape, dtype=np.uint64)
            for k in np.flatnonzero(masks[t]):
                met |= apart[k] & masks[t, k]
            near &= (met != 0) | (t >= table)
        return near

    def run(batches):
        for rows in _whole_buckets(batches):
            bucket, table, side, same = (rows[c].combine_chunks().to_numpy() for c in ("bucket", "table", "side", "same"))
            words = np.stack([rows[f"w{k}"].combine_chunks().to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            links, size = np.zeros(len(bucket), dtype=np.int64), np.diff(cuts)
            little = np.repeat((size <= LITTLE) & (same[cuts[:-1]] == 1), size)
            for apart in range(1, LITTLE):  # all small buckets at once: each row and the one so far behind
                x = np.flatnonzero(little[:-apart] & (bucket[:-apart] == bucket[apart:]))
                x = x[linked(words[x], words[x + apart], table[x])]
                links[x] += 1
                links[x + apart] += 1
            wide = np.flatnonzero(~little[cuts[:-1]])
            for lo, hi in zip(cuts[wide], cuts[wide + 1]):
                left = np.arange(lo, hi) if same[lo] else lo + np.flatnonzero(side[lo:hi] == 0)
                right = left if same[lo] else lo + np.flatnonzero(side[lo:hi] == 1)
                for i in range(0, len(left), TILE):
                    own = left[i : i + TILE]
                    near = linked(words[own][:, None], words[right][None], table[lo]) & (own[:, None] != right[None])
                    links[own] += near.sum(axis=1)
                    if not same[lo]:
                        links[right] += near.sum(axis=0)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([*(pa.array(words[some, k].view(np.int64)) for k in range(WORDS)), pa.array(links[some])], [*(f"w{k}" for k in range(WORDS)), "links"])

    return run


def near(prints: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """(fingerprint, links) of the distinct fingerprints (binary) that have others within the
    radius: how many."""
    if not 0 < radius + agree <= BITS or agree < 1:
        raise ValueError("radius and agree must cut a fingerprint into blocks")
    prepare(prints.sparkSession)
    words = [f"w{k}" for k in range(WORDS)]
    placed = prints.select("fingerprint").mapInArrow(_placed(radius, agree), "key long, table int, " + ", ".join(f"{w} long" for w in words))
    shared = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("sides", F.ceil(F.col("c") / TILE).cast("int"))
    members = placed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64(*words), "sides").cast("int"))
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "table", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).cast("int").alias("same"), *words)
    found = tiles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(radius, agree), ", ".join(f"{w} long" for w in words) + ", links long")
    found = found.groupBy(*words).agg(F.sum("links").alias("links"))

    def joined(batches):
        for b in batches:
            flat = np.stack([b.column(k).to_numpy() for k in range(WORDS)], axis=1).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([flat[i : i + BITS // 8] for i in range(0, len(flat), BITS // 8)], pa.binary()), b.column(WORDS)], ["fingerprint", "links"])

    return found.mapInArrow(joined, "fingerprint binary, links long")


def likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    class_id, n_links): likenesses are the share of equal bits; class_id is the least id with an
    equal fingerprint, n_links counts the other fingerprints within the radius."""
    rows = edited(docs, id_col, text_col)
    classes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")), 20_000)
    known = classes.join(near(classes, radius), "fingerprint", "left").where("size > 1 or links > 0")
    alike = lambda bits: 1 - F.col(bits) / BITS
    out = rows.join(known, "fingerprint", "left")
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), alike("bits_edited").alias("near_edited"), alike("bits_next").alias("near_next"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
