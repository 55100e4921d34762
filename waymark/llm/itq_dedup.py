"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking.

A rotation learned on a bounded sample turns each vector into BITS balanced bits, cut
into CHUNKS chunks.  There is a table for every pair of chunks, keyed by both values: two
codes that differ in at most CHUNKS - 2 bits always share a table, others with a
probability that the recall test measures.  Pairs that share a table are compared by the
cosine of the original vectors in double precision.

* Equal vectors of a label are one class, told by 128 bits of hashes; copies are counted,
  not paired, and only a class's vector is moved, in the type that it came in.
* A pair is compared only in the first table that it shares.
* A bucket is cut into tiles of about TILE codes a side, each a task's group of rows at most.
  Tiles of codes come first: only vectors with another within NEAR bits go on to tiles of
  vectors.  A tile is one matrix product and returns a count for each vector and edges that
  span its components, never its pairs.  No bucket is capped.
* With many vectors a label, ``of`` = 3 keys the tables by three chunks (56 tables of 24
  bits): shorter buckets for twice the rows.

Defined results: a vector that is null, zero or holds null or non-finite components, and
one whose label or id is null, links with nothing; vectors of different length don't link;
rows with equal ids count as vectors of their own, in one component; component_id of a
null id is null and it isn't kept.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .session import cut, prepare

BITS, CHUNKS = 64, 8
WIDTH = BITS // CHUNKS
#: Bits in which the codes of a pair may differ: at a cosine of 0.98 they differ in 4 on average.
NEAR = 18
#: Rows of a bucket up to which buckets are compared together.
LITTLE = 16
THRESHOLD = 0.98
SAMPLE, ROUNDS, TILE = 20_000, 30, 512
#: ``link`` at the defaults as DuckDB SQL.
ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, l.b) AS component_id, e.vec_id = least(e.vec_id, l.b) AS kept
FROM embeddings e LEFT JOIN lowest l ON e.vec_id = l.a LEFT JOIN degree d ON e.vec_id = d.a
"""


def learn(sample: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of BITS columns): principal axes, each block of them rotated by ITQ.

    With fewer dimensions than BITS further rotations of the same axes fill up.
    """
    dim = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, : min(dim, BITS)]
    reduced = centred @ axes
    random = np.random.default_rng(seed)
    blocks = []
    while sum(b.shape[1] for b in blocks) < BITS:
        rotation = np.linalg.qr(random.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ reduced)
            rotation = (u @ v).T
        blocks.append(axes @ rotation)
    return mean, np.column_stack(blocks)[:, :BITS]


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (vectors - mean) @ projection >= 0
    return (bits.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def tables(of: int) -> list[tuple[int, ...]]:
    return list(combinations(range(CHUNKS), of))


def _first_table(differ: np.ndarray, of: int) -> np.ndarray:
    """Index of the first table two codes share, from the bits in which they differ."""
    clean = np.stack([(differ >> np.uint64(WIDTH * c)) & np.uint64((1 << WIDTH) - 1) for c in range(CHUNKS)]) == 0
    out = np.full(differ.shape, -1, dtype=np.int16)
    known = tables(of)
    for t in range(len(known) - 1, -1, -1):
        out[clean[list(known[t])].all(axis=0)] = t
    return out


def _spanning(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component, given a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _tile(ids, sizes, code, unit, side, same, table, threshold, of):
    """(per-vector counts of linked vectors, edges) of one tile."""
    if same:
        a = b = np.arange(len(ids))
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    linked = unit[a] @ unit[b].T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    x, y = np.nonzero(linked)
    good = _first_table(code[a[x]] ^ code[b[y]], of) == table
    x, y = a[x[good]], b[y[good]]
    counts = np.bincount(x, sizes[y], len(ids))
    if not same:
        counts += np.bincount(y, sizes[x], len(ids))
    touched = np.unique(np.concatenate((x, y)))
    square = np.zeros((len(touched),) * 2, dtype=bool)
    at, to = np.searchsorted(touched, x), np.searchsorted(touched, y)
    square[at, to] = square[to, at] = True
    label = _spanning(square) if len(touched) else touched
    return counts, ids[touched], ids[touched[label]] if len(touched) else touched


def _by_bucket(batches):
    """Tables of whole buckets, of batches sorted by bucket."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        keys = b.column(0).to_numpy()
        if held[0]["bucket"][0].as_py() != keys[-1]:
            now = pa.concat_tables(held)
            last = now.num_rows - int(np.argmin((keys == keys[-1])[::-1])) if (keys != keys[-1]).any() else now.num_rows - len(keys)
            yield now.slice(0, last)
            held = [now.slice(last)]
    if held:
        yield pa.concat_tables(held)


def _bounds(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))


def _candidates(of: int):
    """Of tiles of codes the rows that have another within NEAR bits, first met in this table."""

    def run(batches):
        for rows in _by_bucket(batches):
            bucket, code, side, same, table = (rows[c].combine_chunks().to_numpy() for c in ("bucket", "code", "side", "same", "table"))
            code, keep, cuts = code.view(np.uint64), np.zeros(rows.num_rows, dtype=bool), _bounds(bucket)
            size = np.diff(cuts)
            little = np.repeat((size <= LITTLE) & (same[cuts[:-1]] == 1), size)
            for apart in range(1, LITTLE):  # all small buckets at once: each row and the one so far behind
                x = np.flatnonzero(little[:-apart] & (bucket[:-apart] == bucket[apart:]))
                x = x[np.bitwise_count(code[x] ^ code[x + apart]) <= NEAR]
                x = x[_first_table(code[x] ^ code[x + apart], of) == table[x]]
                keep[x] = keep[x + apart] = True
            wide = np.flatnonzero(~little[cuts[:-1]])
            for lo, hi in zip(cuts[wide], cuts[wide + 1]):
                left = np.arange(lo, hi) if same[lo] else lo + np.flatnonzero(side[lo:hi] == 0)
                right = left if same[lo] else lo + np.flatnonzero(side[lo:hi] == 1)
                for i in range(0, len(left), TILE):  # hashing may deal a side more than TILE
                    own = left[i : i + TILE]
                    near = np.bitwise_count(code[own][:, None] ^ code[right][None, :]) <= NEAR
                    near &= own[:, None] != right[None, :]
                    x, y = np.nonzero(near)
                    good = _first_table(code[own[x]] ^ code[right[y]], of) == table[lo]
                    keep[own[x[good]]] = keep[right[y[good]]] = True
            yield from rows.select(["bucket", "id", "side", "same", "table"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _compare(threshold: float, of: int):
    columns = ["bucket", "id", "size", "code", "side", "same", "table", "vector"]

    def run(batches):
        for rows in _by_bucket(batches):
            yield from work(rows)

    def work(rows: pa.Table):
        if not rows.num_rows:
            return
        get = {c: rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in columns[:-1]}
        flat = rows["vector"].combine_chunks()
        width = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy()
        begin = np.concatenate(([0], np.cumsum(width)))
        cuts = _bounds(get["bucket"])
        ids, counts, ends, starts = [], [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo < 2:
                continue
            unit = values[begin[lo] : begin[hi]].reshape(hi - lo, -1).astype(np.float64)
            unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
            n, end, start = _tile(get["id"][lo:hi], get["size"][lo:hi], get["code"][lo:hi].view(np.uint64), unit, get["side"][lo:hi], bool(get["same"][lo]), get["table"][lo], threshold, of)
            some = n > 0
            ids.append(get["id"][lo:hi][some])
            counts.append(n[some].astype(np.int64))
            ends.append(end)
            starts.append(start)
        if ids:
            a, c = np.concatenate(ids), np.concatenate(counts)
            e, s = np.concatenate(ends), np.concatenate(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, e))), pa.array(np.concatenate((c, np.zeros(len(e), np.int64)))), pa.array(np.concatenate((a, s)))], ["id", "links", "other"])

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, of: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row."""
    spark = prepare(vectors.sparkSession)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sound &= ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    same = [F.size("vector").alias("dim"), F.xxhash64("vector").alias("one"), F.xxhash64(F.lit("two"), "vector").alias("two")]
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    thin = cut(rows.select("vec_id", "label", "sound", *same))
    by = ["label", "dim", "one", "two"]
    classes = rows.where("sound").select("vec_id", "label", "vector", *same).groupBy(*by).agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("vector").alias("vector"))

    chosen = rows.where("sound").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector", F.size("vector").alias("dim")).toArrow()
    dims = chosen["dim"].to_numpy()
    learned = {}
    for d in np.unique(dims).tolist():
        flat = chosen.filter(pa.array(dims == d))["vector"].combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)
        learned[d] = learn(np.unique(flat, axis=0) / np.linalg.norm(np.unique(flat, axis=0), axis=1)[:, None])
    shared = spark.sparkContext.broadcast(learned)

    def encode(batches):
        for b in batches:
            dim, out = b.column(1).to_numpy(), np.zeros(b.num_rows, dtype=np.uint64)
            lists = b.column(2)
            begin, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.stack([values[begin[i] : begin[i + 1]] for i in at]).astype(np.float64)
                mean, projection = shared.value.get(int(d)) or learn(np.eye(int(d)))
                out[at] = codes(x / np.linalg.norm(x, axis=1)[:, None], mean, projection)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), b.column(4), pa.array(out.view(np.int64)), lists], ["id", "label", "dim", "size", "code", "vector"])

    # the classes' own columns are kept beside the code; a vector is shuffled and written once
    coded = classes.select("id", "dim", "vector", "label", "size").mapInArrow(encode, f"id long, label string, dim int, size long, code long, vector {kind}")
    coded = cut(coded, 20_000)
    shared.destroy()
    chunk = lambda c: F.shiftrightunsigned("code", WIDTH * c).bitwiseAND((1 << WIDTH) - 1)
    keys = F.array(*(sum((F.shiftleft(chunk(c), WIDTH * at) for at, c in enumerate(chunks)), F.lit(0).cast("long")) for chunks in tables(of)))
    placed = coded.select("id", "code", "label", "dim", F.posexplode(keys).alias("table", "value"))
    placed = placed.select("id", "code", F.xxhash64("label", "dim", "table", "value").alias("key"), F.col("table").cast("int").alias("table"))
    shared_keys = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("sides", F.ceil(F.col("c") / TILE).cast("int"))
    members = placed.join(shared_keys, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), "sides").cast("int"))
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "id", "code", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).cast("int").alias("same"), "table")
    near = tiles.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_candidates(of), "bucket long, id long, side int, same int, table int")
    full = near.join(coded.select("id", "size", "code", "vector"), "id").select("bucket", "id", "size", "code", "side", "same", "table", "vector")
    found = cut(full.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_compare(threshold, of), "id long, links long, other long"))

    near = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = cut(thin.where("sound").groupBy(*by).agg(F.min("vec_id").alias("id"), F.count("*").alias("size")))
    tie = thin.where("sound").join(classes.select(*by, "id"), by).groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    linked = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(tie.select("a", "b")))
    known = classes.join(near, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(*(F.col(c).alias(f"_{c}") for c in by), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "id").alias("_component"))
    out = thin.join(known, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in by), F.col("sound")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
