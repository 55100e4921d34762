"""MinHash near-duplicate removal with tensored banding and exact verification.

Two collections of ROWS-wide minhash groups are drawn, GROUPS in each; the table (i, j)
is keyed by group i of the first together with group j of the second.  GROUPS**2 tables
of 2 * ROWS rows so cost 2 * GROUPS * ROWS minhashes instead of GROUPS**2 * 2 * ROWS.
A pair of similarity s meets in some table with probability (1 - (1 - s**3)**10)**2:
0.998 at 0.8, 0.99999 at 0.9.

* Documents with the same set of shingles form one class at once; only classes go on.
* A group value that a single class has can't take part in a table key that two
  classes share, so keys are formed of shared values alone.
* A class's hub is, of all classes that it shares a bucket with, the one whose group
  values are shared most often: among near copies that is a text close to their origin.
  Classes of one hub are compared with each other exactly, in tiles of bounded size that
  return edges spanning their links, never pairs: thousands of near copies make no pairs.
* Pairs that share a bucket but no hub are compared one by one, unless a chain of links
  joins them already; a bucket with more than PAIRED such classes is compared in tiles, too.  Links are confirmed on full sets throughout; nothing is capped.

Defined results: a text without words (or null) has an empty set and links with
nothing; fewer than SHINGLE words make one shingle; rows with equal ids are one document
for links; a null id links with nothing, has a null component and isn't kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, positions
from .graph import components
from .session import append_columns, cut, prepare
from .textops import chunks, mix, release, shingle_hashes, texts_of, word_hashes, trim

SHINGLE, PERCENT = 5, 80
ROWS, GROUPS = 3, 10
#: Size of a tile's side, and columns of its incidence matrices at a time.
TILE_ROWS, TILE_SHINGLES, VOCABULARY = 512, 400_000, 2048
#: Classes of a bucket up to which its pairs are formed.
PAIRED = 64
#: ``near_duplicates`` with shingle=4 as DuckDB SQL.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, b) AS component_id, doc_id = least(doc_id, b) AS kept
FROM sets LEFT JOIN lowest ON doc_id = a
"""


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def group_values(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 2 * GROUPS group values of each set (bounds without empty sets)."""
    made = np.empty((len(bounds) - 1, 2 * GROUPS), dtype=np.uint64)
    least = np.empty((ROWS, len(bounds) - 1), dtype=np.uint64)
    factors = _multipliers(2 * GROUPS * ROWS)
    steps = _multipliers(ROWS)
    work = np.empty_like(hashes)
    for g in range(2 * GROUPS):
        for r in range(ROWS):
            np.multiply(hashes, factors[g * ROWS + r], out=work)
            np.minimum.reduceat(work, bounds[:-1], out=least[r])
        made[:, g] = mix((least * steps[:, None]).sum(axis=0, dtype=np.uint64))
    return made


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, groups): the size of each set, a 128-bit digest
    of it that doesn't depend on order, and its group values (null for an empty set)."""

    def sign(batches):
        release()
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                hashes, bounds = shingle_hashes(*word_hashes(texts[i:j], lower=True), shingle)
                sets = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets)
                full = np.flatnonzero(sizes)
                at = np.concatenate(([0], np.cumsum(sizes[full])))
                groups = group_values(flat, at) if len(full) else np.empty((0, 2 * GROUPS), np.uint64)
                digest = np.zeros((2, j - i), dtype=np.uint64)
                if len(full):
                    digest[0, full] = np.add.reduceat(mix(flat), at[:-1])
                    digest[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1])
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * 2 * GROUPS))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(groups.reshape(-1).view(np.int64)), mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "groups"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, groups array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles array<long>) of the documents named in ids, as a checkpoint.

    Texts that a Bloom filter of the ids rules out are left where they lie; the others'
    sets, not their texts, meet the ids in an exact join.
    """
    bloom = Bloom(ids, "id")

    def emit(batches):
        release()
        for b in batches:
            hit = pa.array(bloom.hits(b.column(2)))
            names, texts = b.column(0).filter(hit), texts_of(b.column(1).filter(hit))
            for i, j in chunks(texts):
                hashes, bounds = shingle_hashes(*word_hashes(texts[i:j], lower=True), shingle)
                sets = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])
        trim()

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"), positions(key).alias("bits"))
    sets = cut(rows.mapInArrow(emit, "id long, shingles array<long>").join(ids.hint("merge"), "id", "left_semi"), 10_000)
    bloom.close()
    return sets


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id, n, score): the table keys of each class whose both halves another class has
    too; score counts how often its group values occur."""
    halves = classes.select("id", "n", F.posexplode("groups").alias("g", "value"))
    shared = halves.groupBy("g", "value").agg(F.count("*").alias("c")).where("c > 1")
    mine = halves.join(shared, ["g", "value"]).groupBy("id", "n").agg(F.collect_list(F.struct("g", "value")).alias("own"), F.sum("c").alias("score"))
    sides = mine.select("id", "n", "score", F.filter("own", lambda x: x["g"] < GROUPS).alias("one"), F.filter("own", lambda x: x["g"] >= GROUPS).alias("two"))
    rows = sides.select("id", "n", "score", F.explode("one").alias("x"), "two").select("id", "n", "score", "x", F.explode("two").alias("y"))
    return rows.select(F.xxhash64("x.g", "x.value", "y.g", "y.value").alias("key"), "id", "n", "score")


def _links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the linked classes of a tile: all against all, or side 0 against 1."""
    a = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    if len(a) < 1 + same or not len(b):
        return ids[:0], ids[:0]
    sizes = np.array([len(s) for s in sets])
    flat = lambda of: (np.concatenate([sets[i] for i in of]), np.repeat(np.arange(len(of)), sizes[of]))
    x, own = flat(a)
    y, other = (x, own) if same else flat(b)
    if same:
        found, times = np.unique(x, return_counts=True)
        common = found[times > 1]
    else:
        common = np.intersect1d(x, y)
    both = np.zeros((len(a), len(b)), dtype=np.float32)

    def part(tokens, owner, rows, vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
        hit = vocabulary[at] == tokens
        out = np.zeros((rows, len(vocabulary)), dtype=np.float32)
        out[owner[hit], at[hit]] = 1
        return out

    for i in range(0, len(common), VOCABULARY):
        left = part(x, own, len(a), common[i : i + VOCABULARY])
        both += left @ (left if same else part(y, other, len(b), common[i : i + VOCABULARY])).T
    linked = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
    if same:
        np.fill_diagonal(linked, False)
    p, q = np.nonzero(linked)
    p, q = a[p], b[q]
    label = np.arange(len(ids))
    while len(p):
        before = label.copy()
        np.minimum.at(label, p, label[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[moved]], ids[moved]


def _tiles(percent: int):
    def run(batches):
        release()
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            keys = b.column(0).to_numpy()
            if (change := np.flatnonzero(keys[1:] != keys[:-1])).size or (len(held) > 1 and held[-2]["tile"][-1].as_py() != keys[0]):
                last = int(change[-1]) + 1 if change.size else 0
                yield from work(pa.concat_tables([*held[:-1], held[-1].slice(0, last)]))
                held = [held[-1].slice(last)]
        if held:
            yield from work(pa.concat_tables(held))
        held.clear()
        trim()

    def work(rows: pa.Table):
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return
        tile, ids, side, same = (rows[c].to_numpy() for c in ("tile", "id", "side", "same"))
        lists = rows["shingles"].combine_chunks()
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        found = [_links(ids[i:j], [values[bounds[k] : bounds[k + 1]] for k in range(i, j)], side[i:j], bool(same[i]), percent) for i, j in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    return run


def within_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that span the links among the members (hub, id, n) of each hub.

    A hub's members are dealt to sides of about TILE_ROWS rows and TILE_SHINGLES shingles;
    each pair of sides is a tile, so a hub of any size spreads over many tasks.
    """
    sums = members.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1")
    sides = F.greatest(F.ceil(F.col("c") / TILE_ROWS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    dealt = members.join(sums.select("hub", sides.alias("sides")), "hub").withColumn("own", F.pmod(F.xxhash64("id", "hub"), "sides").cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select("id", F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).cast("int").alias("same"))
    rows = tiles.join(sets, "id").select("tile", "id", "side", "same", "shingles")
    return rows.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(_tiles(percent), "a long, b long")


def near_enough(m: str, n: str, percent: int):
    """What any pair of sets of these sizes must fulfil."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, m, n) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("left", "right")))
    return both.where(100 * F.col("common") >= percent * (F.col("m") + F.col("n") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each input row."""
    prepare(docs.sparkSession)
    signed = cut(signatures(docs, id_col, text_col, shingle), 20_000)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.min("groups").alias("groups"))
    reps = cut(classes.select("id", F.col("n_shingles").alias("n"), "set_a", "set_b", "groups"), 20_000)
    table = cut(buckets(reps))
    hub = F.max(F.struct("score", (-F.col("id")).alias("minus"), "n")).alias("hub")
    heads = table.groupBy("key").agg(F.count("*").alias("c"), hub).where("c > 1").drop("c")
    table = table.join(heads, "key").select("key", "id", "n", "hub")
    chosen = table.groupBy("id", "n").agg(F.max("hub").alias("hub"))
    chosen = cut(chosen.select("id", "n", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n")))
    sets = full_sets(docs, chosen.select("id"), id_col, text_col, shingle)
    members = chosen.select("hub", "id", "n").unionByName(chosen.select("hub", F.col("hub").alias("id"), F.col("hub_n").alias("n"))).distinct()
    first = cut(within_hubs(members, sets, percent))
    found = components(first)

    placed = table.select("key", "id", "n").join(chosen.select("id", F.col("hub").alias("own")), "id")
    placed = placed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    torn = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("own").alias("one"), F.max("own").alias("two"))
    rest = cut(placed.join(torn.where("low < high and one < two").select("key"), "key", "left_semi"))
    wide = cut(rest.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > PAIRED).select("key"))
    tiled = bool(wide.take(1))
    buckets_of_many = rest.join(wide, "key", "left_semi").select(F.col("key").alias("hub"), "id", "n")
    rest = rest.join(wide, "key", "left_anti") if tiled else rest
    other = rest.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("component").alias("component2"), F.col("own").alias("own2"))
    across = rest.select("key", F.col("id").alias("a"), F.col("n").alias("n1"), "component", "own").join(other, "key")
    across = across.where((F.col("a") < F.col("b")) & (F.col("component") != F.col("component2")) & near_enough("n1", "n2", percent))
    across = across.where((F.col("own") != F.col("own2")) & (F.col("own") != F.col("b")) & (F.col("own2") != F.col("a")))
    across = across.select("a", "b", F.col("n1").alias("m"), F.col("n2").alias("n")).distinct()
    second = confirmed(across, sets, percent)
    links = first.unionByName(second)
    if tiled:
        links = links.unionByName(within_hubs(buckets_of_many, sets, percent))
    # rows with one id but different texts tie their classes together
    own = ["n_shingles", "set_a", "set_b"]
    texts = usable.select("doc_id", *own).distinct()
    several = texts.join(texts.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1"), "doc_id", "left_semi")
    several = several.join(reps.select(F.col("n").alias("n_shingles"), "set_a", "set_b", "id"), own).select("doc_id", "id")
    twice = several.join(several.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    found = components(links.unionByName(twice))

    whole = reps.select("id", "n", "set_a", "set_b").join(found.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.select(F.col("n").alias("_n"), F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("component", "id").alias("_component"))
    out = signed.join(whole, (F.col("n_shingles") == F.col("_n")) & (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id isn't a near copy of a lesser one; rows without an id stay.

    Few rows are dropped.  Those that a Bloom filter of the dropped ids rules out are kept
    where they lie; only the others meet the dropped ids in an exact join.
    """
    dropped = cut(near_duplicates(docs, id_col, text_col, shingle, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_waymark_dropped")).distinct())
    bloom = Bloom(dropped, "_waymark_dropped")
    key = F.col(id_col).cast("long")
    at = len(docs.columns)
    rows = append_columns(docs.withColumn("_waymark_bits", positions(key)), [("_waymark_maybe", "boolean")], lambda b: [pa.array(bloom.hits(b.column(at)))])
    sure = rows.where("not _waymark_maybe").select(*docs.columns)
    checked = rows.where("_waymark_maybe").join(dropped.hint("merge"), key == F.col("_waymark_dropped"), "left_anti").select(*docs.columns)
    return sure.unionByName(checked)
