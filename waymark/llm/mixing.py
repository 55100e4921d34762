"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) get the weights in turn and share ``share``
times all sizes.  A target stops at ``cap`` times its source's size; what it can't
take is shared by weight among the others.  Every document of a source expects the
same number of copies, target / source size.  The documents of a source lie in order
of size, then of a hash; the running sum of expected copies plus one offset drawn for
the source gives a document one copy for each integer boundary that it crosses.  The
order by size makes the words taken follow the target closely.

Sums are integers in units of 2**-24 copies, so a document never gets more than
``cap`` copies by rounding, and reruns agree.  The running rank over a source uses a
range partitioning by (source, size, hash): a source may hold any share of the rows.

Defined results: a null text has size 0; documents of size 0 are ranked like others and
take no words; a source without words has target 0 and no copies; repeated rows each
count; other columns of the input are ignored by ``mix`` and kept by ``apply_mix``,
which emits each row as often as it has copies, null and repeated ids included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import reliable
from .session import cut, prepare
from .textops import WORD

UNIT = 1 << 24
SEED = "waymark"
#: The defaults of ``mix`` as DuckDB SQL.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sums
), steps AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * (sum(source_size) OVER upto - source_size)) /
    (sum(weight) OVER () - (sum(weight) OVER upto - weight)) AS level
  FROM steps WINDOW upto AS (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)
), target AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, (ratio, place)) FROM levels WHERE level <= ratio), 'inf'::DOUBLE) * weight) AS target,
    ('0x' || substr(md5('waymark' || '|' || coalesce(source, '')), 1, 6))::BIGINT AS start FROM levels
), ranked AS (
  SELECT s.*, t.source_size, t.target, t.start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216)::BIGINT ELSE 0 END AS step,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5('waymark' || '|' || s.doc_id::VARCHAR), s.doc_id) AS place
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * ((place * step + start) // 16777216 - ((place - 1) * step + start) // 16777216) AS taken FROM ranked
"""


def targets(sums: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row for each source.

    Taken in order of cap / weight, the first source that isn't capped fixes the level:
    targets are the level times the weight, or the cap where that is less.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place - 1) % len(weights) + 1)
    steps = sums.select("source", "source_size", weight.alias("weight"), place.alias("place"))
    steps = steps.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    whole, upto = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(cap)) * (F.sum("source_size").over(upto) - F.col("source_size"))
    levels = steps.withColumn("level", room / (F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight"))))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place"))).over(whole)
    return levels.select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each input row."""
    prepare(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _size(text_col).alias("size"),
    )
    salted = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut(sized.withColumn("hash", salted).withColumn("row", F.monotonically_increasing_id()), 20_000)
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit(""))).cast("binary")), 1, 6), 16, 10).cast("long")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    goals = goals.withColumn("start", start).withColumn("step", step)

    order = [F.col("source").asc_nulls_last(), "size", "hash", "doc_id", "row"]
    parts = reliable(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part", "source").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    known = counts.alias("c").join(goals.alias("g"), same(counts, goals)).select("c.part", "c.source", "c.earlier", "g.source_size", "g.target", "g.start", "g.step")
    inner = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "hash", "doc_id", "row"))
    ranked = parts.withColumn("inner", inner)
    out = ranked.alias("r").join(known.alias("k"), (F.col("r.part") == F.col("k.part")) & F.col("r.source").eqNullSafe(F.col("k.source")))
    place = F.col("k.earlier") + F.col("r.inner")
    crossed = lambda at: F.shiftright(at * F.col("k.step") + F.col("k.start"), 24)
    return out.select("r.doc_id", "r.source", "r.size", "k.source_size", "k.target", (crossed(place) - crossed(place - 1)).alias("copies"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as ``mixed`` has copies of it.

    Rows of one id, source and size are alike to ``mix``, so they take its decisions on
    them in turn, in order of a hash of their texts.
    """
    key = ["_waymark_id", "_waymark_source", "_waymark_size"]
    turn = lambda df, *by: df.withColumn("_waymark_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    chosen = mixed.select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]), F.col("copies").cast("int").alias("_waymark_copies"))
    chosen = turn(chosen, F.col("_waymark_copies").desc())
    named = docs.withColumns({key[0]: F.col(id_col).cast("long"), key[1]: F.col(source_col).cast("string"), key[2]: _size(text_col)})
    named = turn(named, F.xxhash64(F.col(text_col))).alias("d")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*key, "_waymark_turn"]]
    out = named.join(chosen.where("_waymark_copies > 0").alias("c"), reduce(lambda a, b: a & b, same))
    return out.withColumn("_waymark_copy", F.explode(F.sequence(F.lit(1), F.col("_waymark_copies")))).select(*(F.col(f"d.`{c}`") for c in docs.columns))
