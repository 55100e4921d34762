"""Connected components by local forests and alternating large and small stars.

Each task first replaces its edges by a forest that joins the same nodes, with every node
tied to the least one of its tree.  A graph of at most FEW edges is then finished as one such
forest in a single task; a larger one goes through rounds of stars until nothing changes.
Stars are minima by node (combined before the shuffle) joined back to the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .textops import release

#: Edges that one task may finish: 16 bytes each, and twice that again while it works.
FEW = 1 << 18
#: Edges that a task gathers before it replaces them by their forest.
GATHER = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of each node that isn't its component's least."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    p, q = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(p):
        before = label.copy()
        low = np.minimum(label[p], label[q])
        for side in (p, q, before[p], before[q]):
            np.minimum.at(label, side, low)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _forests(batches):
    release()
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        u, v = np.concatenate((u, b.column(0).to_numpy())), np.concatenate((v, b.column(1).to_numpy()))
        if len(u) > GATHER:
            u, v = forest(u, v)
            if len(u) > GATHER // 2:  # a task of many nodes passes on what it has
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = u[:0], v[:0]
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach.

    Loops and repeated edges are allowed, nodes without edges don't appear; an edge with
    a null end is ignored.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    pairs = cut(pairs.mapInArrow(_forests, "u long, v long"))
    if pairs.limit(few + 1).count() <= few:
        pairs = pairs.coalesce(1).mapInArrow(_forests, "u long, v long")
    else:
        pairs = _stars(pairs)
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(pairs: DataFrame) -> DataFrame:
    stamp = None
    while (now := _stamp(pairs)) != stamp:
        stamp = now
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut(small)
    return pairs
