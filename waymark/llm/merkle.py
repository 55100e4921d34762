"""Merkle manifest of a dataset as a radix-ranked trie.

Every row is a leaf: the SHA-256 of its canonical bytes.  Leaves of a group ascend by id; each
``fanout`` consecutive nodes become one until one is left, the group's subroot, and the
subroots, ordered by group, become the root in the same way.

*Ranks without a global sort.*  An id is a row of digits (16 bits each, the last of 8).  A
histogram of the longest digit prefixes is rolled up digit by digit; then each prefix, from
the shortest to the longest, gets its first rank: that of its parent and the counts of its
lesser siblings.  A bucket of the longest prefix holds at most 256 ids, and rows are ordered
inside their bucket only.  A bucket that many rows share (an id that repeats, or null) is split
by the whole id and by 16 further digits from the leaf; at most 2**14 buckets are, which bounds
their broadcast.  Equal rows are counted before anything is shuffled by rank and take a run of ranks.

*Nodes by rank digits.*  The digits of a leaf's rank to the base ``fanout`` are its path in a
trie.  Leaves whose ranks agree in all but the last digits (``CHUNK`` leaves at most) are one
subtree, hashed in one place; its node is a leaf of the trie of the remaining prefix, and so on
until the prefixes are empty.  Proofs come back down the same way: a subtree's own path is
followed by that of its leaves.  What a task holds is one subtree.

Defined results: null ids come first in their group and a null group first of all; rows that
repeat an id are ordered by leaf, equal rows stand beside each other, each with its own
place and proof; an empty table has no rows (and no root); a lone leaf is its group's subroot,
a lone subroot the root; a text is hashed whole, whatever its length.  Columns of the input
other than those asked for are ignored, so their names can't clash; columns of ``also`` may
have any name but those of the result.  Digests are lower-case hexadecimal.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable
from .session import cut, prepare

CHUNK = 1024
#: Digit prefixes of an id, as numbers of trailing bits left out.
SHIFTS = (8, 24, 40, 56)
#: At most so many buckets are split further, each of at least LEAST rows.
SPLIT, LEAST = 1 << 14, 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The query as DuckDB SQL.
ORACLE_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS back,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT + 256, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: xor((CASE WHEN x < 0 THEN a ELSE xor(a, x - 256) END) >> 1, CASE WHEN (CASE WHEN x < 0 THEN a ELSE xor(a, x - 256) END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || back) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(front || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || back) END AS tampered FROM fields
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM leaves
), lower_nodes AS (
  SELECT 0 AS level, grp, place AS i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM ranked
  UNION ALL
  SELECT level + 1, grp, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM lower_nodes WHERE n > 1 GROUP BY level, grp, i // 2
), subroots AS (
  SELECT grp, h AS subroot, level AS height FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, grp AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 2
), top AS (
  SELECT h AS root, level AS height FROM upper_nodes WHERE n = 1
), walk AS (
  SELECT r.doc_id, r.leaf, r.grp, r.place, 0 AS step, coalesce(r.tampered, r.leaf) AS h, '' AS proof, s.subroot, s.height, t.root, t.height AS above
  FROM ranked r JOIN subroots s USING (grp) CROSS JOIN top t
  UNION ALL
  SELECT w.doc_id, w.leaf, w.grp, w.place, w.step + 1,
    sha256(CASE WHEN d % 2 = 1 THEN coalesce(x.h, '') || w.h ELSE w.h || coalesce(x.h, '') END), w.proof || coalesce(x.h, ''), w.subroot, w.height, w.root, w.above
  FROM (SELECT *, CASE WHEN step < height THEN place >> step ELSE grp >> (step - height) END AS d FROM walk WHERE step < height + above) w
  LEFT JOIN (SELECT level, grp, i, h, false AS upper FROM lower_nodes UNION ALL SELECT level, 0, i, h, true FROM upper_nodes) x
    ON x.upper = (w.step >= w.height) AND x.level = CASE WHEN w.step < w.height THEN w.step ELSE w.step - w.height END
    AND x.grp = CASE WHEN w.step < w.height THEN w.grp ELSE 0 END AND x.i = xor(d, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM walk WHERE step = height + above
"""


def field(value: Column) -> Column:
    """Canonical form of a value: `-` if null, else its UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _digits(by: str, shift: int) -> Column:
    return F.shiftright(by, shift)


def ranked(leaves: DataFrame, least: int = LEAST) -> DataFrame:
    """Leaves (grp, has, id, leaf, copies, ...) with (rank, total): the first rank of each
    within its group, and the rows of the group, by digit histograms."""
    buckets = leaves.groupBy("grp", "has", _digits("id", SHIFTS[0]).alias("at")).agg(F.count("*").alias("rows"))
    least = max(least, leaves.count() // SPLIT)  # so fewer than SPLIT buckets are wide
    wide = buckets.where(F.col("rows") > least).select("grp", "has", "at", F.lit(True).alias("wide"))
    keyed = leaves.withColumn("at", _digits("id", SHIFTS[0])).join(F.broadcast(wide), ["grp", "has", "at"], "left").drop("at")
    whole = F.when(F.col("wide"), F.col("id")).otherwise(F.shiftleft(_digits("id", SHIFTS[0]), SHIFTS[0]))
    more = F.when(F.col("wide"), F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int")).otherwise(0)
    keyed = keyed.withColumns({"d": whole, "more": more}).drop("wide")

    longest = cut(keyed.groupBy("grp", "has", "d", "more").agg(F.sum("copies").alias("n")))
    levels = [longest, longest.groupBy("grp", "has", "d").agg(F.sum("n").alias("n"))]
    for shift in SHIFTS:
        levels.append(levels[-1].groupBy("grp", "has", F.shiftleft(_digits("d", shift), shift).alias("d")).agg(F.sum("n").alias("n")))
    group = Window.partitionBy("grp")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = levels[-1].select("grp", "has", "d", before(group.orderBy("has", "d")).alias("start"), F.sum("n").over(group).alias("total"))
    for level, shift in zip(reversed(levels[1:-1]), reversed(SHIFTS)):
        parent = F.shiftleft(_digits("d", shift), shift)
        inner = level.withColumn("p", parent).withColumn("inner", before(Window.partitionBy("grp", "has", "p").orderBy("d")))
        starts = inner.join(starts.withColumnRenamed("d", "p"), ["grp", "has", "p"]).select("grp", "has", "d", (F.col("start") + F.col("inner")).alias("start"), "total")
    inner = longest.withColumn("inner", before(Window.partitionBy("grp", "has", "d").orderBy("more")))
    starts = inner.join(starts, ["grp", "has", "d"]).select("grp", "has", "d", "more", (F.col("start") + F.col("inner")).alias("start"), "total")
    order = [c for c in leaves.columns if c not in ("grp", "has", "copies")]
    place = Window.partitionBy("grp", "has", "d", "more").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = keyed.join(starts, ["grp", "has", "d", "more"])
    return found.withColumn("rank", F.col("start") + F.coalesce(F.sum("copies").over(place), F.lit(0))).drop("start", "d", "more")


def leaves_of_subtree(fanout: int, chunk: int = CHUNK) -> int:
    """Leaves of a whole subtree: the greatest power of the fanout up to ``chunk``."""
    n = fanout
    while n * fanout <= chunk:
        n *= fanout
    return n


def _height(n: int, fanout: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _levels(nodes: list[bytes], fanout: int, height: int) -> list[list[bytes]]:
    """The nodes of a subtree, level by level from its leaves up."""
    out = [nodes]
    for _ in range(height):
        nodes = [hashlib.sha256(b"".join(nodes[i : i + fanout])).hexdigest().encode() for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def _subtrees(batches, first) -> Iterator[pa.Table]:
    """The rows of one subtree after another; ``first`` marks where each begins."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(first(b))
        last = 0
        for at in begins:
            if at > last:
                held.append(b.slice(last, at - last))
            if held:
                yield pa.Table.from_batches(held)
            held, last = [], at
        held.append(b.slice(last))
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _spread(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """(hexadecimal leaves of a subtree, the row of each)."""
    times = rows["upto"].to_numpy() - rows["lo"].to_numpy()
    flat = hexlify(b"".join(rows["leaf"].to_pylist()))
    own = [flat[i : i + 64] for i in range(0, len(flat), 64)]
    at = np.repeat(np.arange(rows.num_rows), times)
    return [own[i] for i in at], at


def _tops(fanout: int, n: int):
    """The node of each subtree: (grp, total, rank, leaf) of the trie above."""

    def run(batches):
        for rows in _subtrees(batches, lambda b: b["lo"].to_numpy() == 0):
            total = rows["total"][0].as_py()
            top = _levels(_spread(rows)[0], fanout, _height(min(total, n), fanout))[-1][0]
            yield pa.RecordBatch.from_arrays([rows["grp"].slice(0, 1).combine_chunks(), pa.array([-(-total // n)]), rows["chunk"].slice(0, 1).combine_chunks(), pa.array([bytes.fromhex(top.decode())])], ["grp", "total", "rank", "leaf"])

    return run


def _proofs(fanout: int, size: int, carried: list[str]):
    """Of subtrees, each led by the path of its own node, the rows with their paths."""

    def run(batches):
        for rows in _subtrees(batches, lambda b: b["kind"].to_numpy() == 0):
            path = rows["path"][0].as_py() or []
            subroot, root, rows = rows["subroot"][0].as_py(), rows["root"][0].as_py(), rows.slice(1)
            total, lo = rows["total"][0].as_py(), rows["chunk"][0].as_py() * size
            leaves, at = _spread(rows)
            levels = _levels(leaves, fanout, _height(min(total, size), fanout))
            left, right, index, base, n = [], [], [], 0, len(leaves)
            for level, nodes in enumerate(levels[:-1]):
                for j in range(len(nodes)):
                    run_at = j - j % fanout
                    left.append(b"".join(nodes[run_at:j]))
                    right.append(b"".join(nodes[j + 1 : run_at + fanout]))
                index.append(base + np.arange(n) // fanout**level)
                base += len(nodes)
            for k, step in enumerate(path):
                left.append(step["left"].encode())
                right.append(step["right"].encode())
                index.append(np.full(n, base + k))
            take = pa.array(np.stack(index, axis=1).ravel() if index else np.empty(0, np.int64))
            steps = pa.StructArray.from_arrays([pa.array(x, type=pa.binary()).cast(pa.string()).take(take) for x in (left, right)], ["left", "right"])
            proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(index)), steps)
            same = rows.select(carried).take(pa.array(at)).combine_chunks()
            own = [same[c].combine_chunks() if same.num_rows else pa.array([], same.schema.field(c).type) for c in carried]
            columns = [*own, pa.array(lo + rows["lo"][0].as_py() + np.arange(n)), pa.array(leaves, type=pa.binary()).cast(pa.string()), proof, pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "rank", "leaf", "proof", "subroot", "root"])

    return run


def _placed(nodes: DataFrame, n: int) -> DataFrame:
    """Nodes (grp, total, rank, leaf, copies, ...) by subtree, each run of copies cut at the
    borders of subtrees, in order."""
    end = F.col("rank") + F.col("copies")
    parts = nodes.withColumn("chunk", F.explode(F.sequence(F.expr(f"rank div {n}"), F.expr(f"(rank + copies - 1) div {n}"))))
    parts = parts.withColumns({"lo": F.greatest(F.lit(0), F.col("rank") - F.col("chunk") * n), "upto": F.least(F.lit(n), end - F.col("chunk") * n)})
    return reliable(parts.drop("rank", "copies").repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "lo"))


def _climb(nodes: DataFrame, most: int, fanout: int, size: int) -> tuple[list[DataFrame], DataFrame]:
    """(the nodes of each trie by subtree, from the longest prefix to the shortest; the last node of each group)."""
    tries = []
    while True:
        tries.append(_placed(nodes, size))
        nodes = tries[-1].mapInArrow(_tops(fanout, size), "grp string, total long, rank long, leaf binary").withColumn("copies", F.lit(1))
        most = -(-most // size)
        if most <= 1:
            return tries, cut(nodes)


def _descend(tries: list[DataFrame], paths: DataFrame, fanout: int, size: int, carried: list[str]) -> DataFrame:
    """The rows of the longest prefix with their proofs; ``paths`` (grp, path, subroot, root) of the groups."""
    paths = paths.withColumn("chunk", F.lit(0).cast("long"))
    for k in reversed(range(len(tries))):
        kept = [c for c in carried if k == 0] + ["grp"]
        fields = {f.name: f.dataType.simpleString() for f in tries[k].schema.fields}
        lead = paths.select("grp", "chunk", F.lit(0).alias("kind"), "path", "subroot", "root")
        rows = tries[k].withColumn("kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
        rows = rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind", "lo")
        schema = ", ".join(f"`{c}` {fields[c]}" for c in kept)
        out = rows.mapInArrow(_proofs(fanout, size, kept), f"{schema}, rank long, leaf string, proof array<struct<left string, right string>>, subroot string, root string")
        paths = out.select("grp", F.col("rank").alias("chunk"), F.col("proof").alias("path"), "subroot", "root")
    return out


def _in_order(tops: DataFrame) -> DataFrame:
    """One row a group with its rank in the order of groups, by ranges and counts of these."""
    parts = reliable(tops.repartitionByRange("grp").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    counts = counts.select("part", F.sum("n").over(Window.orderBy("part")).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("grp"))
    return parts.withColumn("inner", inner).join(F.broadcast(counts), "part").select("grp", (F.col("upto") - F.col("n") + F.col("inner") - 1).alias("rank"), F.col("total").cast("long").alias("total"), "leaf")


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, also: dict[str, Column] | None = None, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """(doc_id, group, rank, leaf, proof, subroot, root, ...), a row for each row of docs.

    ``leaf`` is the hexadecimal digest of a row (see ``leaf_of``), ``proof`` a list of steps up to
    the root: the digests left and right of the node in its run.  ``also`` names small values
    of a row that shall come with it; a subtree has at most ``chunk`` leaves, a bucket that is not
    split at most ``least`` rows or the 2**14th part of all.
    """
    if not 2 <= fanout <= chunk:
        raise ValueError(f"the fanout must lie between 2 and {chunk}")
    prepare(docs.sparkSession)
    also, size = also or {}, leaves_of_subtree(fanout, chunk)
    grp = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    whole = F.col(id_col).cast("long")
    leaves = docs.select(grp.alias("grp"), whole.isNotNull().cast("int").alias("has"), F.coalesce(whole, F.lit(0)).alias("id"), F.unhex(leaf).alias("leaf"), *(v.alias(f"also_{k}") for k, v in also.items()))
    leaves = cut(leaves.groupBy(*leaves.columns).agg(F.count("*").alias("copies")), 20_000)
    carried = ["has", "id", *(f"also_{k}" for k in also)]
    most = leaves.groupBy("grp").agg(F.sum("copies").alias("n")).agg(F.max("n"), F.count("*")).first()
    tries, subroots = _climb(ranked(leaves, least), most[0] or 1, fanout, size)
    order = _in_order(subroots.select("grp", "leaf"))
    top = order.select(F.lit("").alias("grp"), "total", "rank", "leaf", F.lit(1).alias("copies"), F.col("grp").alias("name"))
    above, root = _climb(top, most[1] or 1, fanout, size)
    ends = root.select("grp", F.array().cast("array<struct<left string, right string>>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("leaf")).alias("root"))
    paths = _descend(above, ends, fanout, size, ["name"])
    paths = paths.select(F.col("name").alias("grp"), F.col("proof").alias("path"), F.col("leaf").alias("subroot"), "root")
    out = _descend(tries, paths, fanout, size, carried)
    name = F.when(F.col("grp") != "", F.expr("substr(grp, 2)"))
    return out.select(F.when(F.col("has") == 1, F.col("id")).alias("doc_id"), name.alias("group"), "rank", "leaf", "proof", "subroot", "root", *(F.col(f"also_{k}").alias(k) for k in also))


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, of
    which those whose id's crc32 seven divides are tampered with."""
    original = [F.col(c) for c in FIELDS]
    changed = [F.try_add(c, F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(docs, leaf_of(*original), also={"tampered": F.when(hit, F.unhex(leaf_of(*changed)))})
    found = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    siblings = F.aggregate("proof", F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"]))
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(found, F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
