"""Operators 11 to 13 against plain versions: Merkle manifest, SimHash, fill-in-the-middle."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import fill_middle, merkle, simhash
from waymark.llm import queries as own

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 manifest ----------------------------------------------------------------


def _plain_manifest(rows, fanout):
    """Multiset of (group, id, leaf, proof, subroot, root) by walking each tree node by node."""
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append((i is not None, i or 0, H("-" if i is None else f"{len(str(i))}:{i}")))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, j in enumerate(at):
                lo = j - j % fanout
                paths[k].append(("".join(nodes[lo:j]), "".join(nodes[j + 1 : lo + fanout])))
            nodes = [H(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
            at = [j // fanout for j in at]
        return nodes[0], paths

    trees = {g: (sorted(v), *tree([x[2] for x in sorted(v)])) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, above = tree([trees[g][1] for g in order])
    out = Counter()
    for g, up in zip(order, above):
        for rank, ((has, i, leaf), path) in enumerate(zip(trees[g][0], trees[g][2])):
            out[g, i if has else None, rank, leaf, tuple(path + up), trees[g][1], root] += 1
    return out


@pytest.mark.parametrize("fanout,chunk,least,n", [(2, 4, 5, 60), (3, 9, 3, 40), (2, 1024, 4096, 30), (5, 7, 1000, 1)])
def test_manifest(spark, fanout, chunk, least, n):
    """Runs of copies over several subtrees, buckets split, a group of one, nulls, negative ids."""
    random = np.random.default_rng(n)
    rows = [(int(i), ("en", "é", "EN", None, "")[i % 5]) for i in random.integers(-600, 600, n)]
    rows += [(7, "en")] * (n // 2) + [(None, "en")] * (n // 4) + [(-(2**63), "en"), (2**63 - 1, "en"), (5, "lone"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string").repartition(3).withColumn("leaf", F.lit("other")).withColumn("rank", F.lit(1))
    made = merkle.manifest(df, merkle.leaf_of(F.col("doc_id")), fanout=fanout, chunk=chunk, least=least, also={"odd": F.col("doc_id") % 7})
    found = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    have = Counter((r["group"], r["doc_id"], r["rank"], r["leaf"], tuple((s["left"], s["right"]) for s in r["proof"]), r["subroot"], r["root"]) for r in found)
    assert have == _plain_manifest(rows, fanout)
    assert all(r["folded"] == r["root"] for r in found)
    assert all(r["odd"] == (None if r["doc_id"] is None else int(np.fmod(r["doc_id"], 7))) for r in found)


def test_split_of_a_repeated_id(spark):
    """An id that many different rows share is split by the digits of its leaves."""
    rows = [(7, f"t{i}", "en", None, None) for i in range(300)] + [(8, "x", "en", None, None), (None, "y", "en", None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    leaf = merkle.leaf_of(F.col("text"))
    found = merkle.manifest(df, leaf, least=10, chunk=16).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(302)) and found[0]["doc_id"] is None and found[-1]["doc_id"] == 8
    assert [r["leaf"] for r in found[1:-1]] == sorted(H(f"{len(t[1])}:{t[1]}") for t in rows[:300])


def test_manifest_of_documents(spark, tmp_path):
    """Awkward rows of the query itself against its definition; an empty table."""
    text = "a long line " * 20_000
    rows = [(i, f"text {i}", ("en", "de", None)[i % 3], None if i % 4 else "s", i if i % 5 else None) for i in range(70)]
    rows += [(None, None, None, None, None), (900, text, "en", "é", 3), (901, "", "", "", 0), (7, "copy", "en", "a", 1), (7, "copy", "en", "a", 1)]
    spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    found = own.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and len({r["root"] for r in found}) == 1
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = Counter((d, H(*map(enc, (d, s, g, n, t)))) for d, t, g, s, n in rows)
    assert Counter((r["doc_id"], r["leaf"]) for r in found) == leaves
    import zlib

    for d, _, _, _, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        assert all(r["verified"] != hit and (r["folded_root"] == r["root"]) == r["verified"] for r in found if r["doc_id"] == d and d != 7)
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert own.op11_merkle_manifest(spark, str(tmp_path / "none")).count() == 0
    assert own.op12_simhash(spark, str(tmp_path / "none")).count() == 0
    assert own.op13_fill_middle(spark, str(tmp_path / "none")).count() == 0


# --- 12 fingerprints -------------------------------------------------------------


def _plain_simhash(text: bytes) -> bytes:
    words = [w.lower() for w in text.split()]
    hashes = [simhash.word_hashes([w])[0][0] for w in words] + [simhash.shingle_hashes(*simhash.word_hashes([b" ".join(words[i : i + 2])]), 2)[0][0] for i in range(max(len(words) - 1, min(len(words), 1)))]
    score = [0] * simhash.BITS
    for h, often in Counter(int(h) for h in hashes).items():
        wide = simhash.mix(np.array([h], dtype=np.uint64) ^ simhash._SEEDS)
        for k, bit in enumerate(np.unpackbits(wide.view(np.uint8))):
            score[k] += (1 if bit else -1) * often.bit_length()
    return np.packbits(np.array(score) > 0).tobytes()


def test_simhash():
    texts = [b"", b"one", b"A b a B a b a b c", b"  x\ty\n", "é😀 z".encode(), b" ".join(b"w%d" % (i % 90) for i in range(400))]
    assert simhash.simhash(texts) == [_plain_simhash(t) for t in texts]
    assert simhash.simhash([b"a b"]) == simhash.simhash([b" A\nB "]) and simhash.simhash([b""]) == [bytes(32)]


def test_edited(spark, tmp_path):
    """Every row meets its successor, also over the borders of ranges; ties, nulls, a lone row."""
    rows = [(i * 3, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 40)) or None, "en", "a", 1) for i in range(120)]
    rows += [(None, "no id 😀😀", None, None, None), (9, "tie b", None, None, None), (9, "tie a", None, None, None), (12, "same", None, None, None), (12, "same", None, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("fingerprint", F.lit(1)).withColumn("part", F.lit(1))
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = own.op12_simhash(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for row, after in zip(order, order[1:] + order[:1]):
        t, a = row[1] or "", after[1] or ""
        e = t[: len(t) - len(t) // 2] + a[: len(t) // 2]
        p, q, n = simhash.simhash([t.encode(), e.encode(), a.encode()])
        near = [1 - int(simhash.differing([p], [x])[0]) / 256 for x in (q, n)]
        want[row[0], len(t), H(e), p.hex(), q.hex(), *near] += 1
    assert Counter(tuple(r)[:7] for r in found) == want
    spark.createDataFrame([(4, "abcd ef", "en", "a", 1)], DOCS).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    (r,) = own.op12_simhash(spark, str(tmp_path / "one")).collect()
    assert r["edited_sha256"] == H("abcdabc") and r["near_next"] == 1 and r["class_id"] == 4 and r["n_links"] == 0


@pytest.mark.parametrize("radius,agree", [(7, 1), (3, 2), (10, 1), (0, 1)])
def test_near(spark, radius, agree):
    """Links of a cloud of close fingerprints, wide buckets and strangers, against all pairs."""
    random = np.random.default_rng(radius)
    seeds = random.integers(0, 2, (3, 256))
    close = np.repeat(seeds, [1500, 40, 3], axis=0)
    for row in close:
        row[random.choice(256, random.integers(0, radius + 2), replace=False)] ^= 1
    bits = np.unique(np.concatenate((close, random.integers(0, 2, (300, 256)))), axis=0)
    packed = np.packbits(bits, axis=1)
    words = packed.view(np.uint64)
    n = (np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= radius).sum(axis=1) - 1
    df = spark.createDataFrame([(bytes(p),) for p in packed], "fingerprint binary").repartition(4)
    found = {bytes(r["fingerprint"]): r["links"] for r in simhash.near(df, radius, agree).collect()}
    assert found == {bytes(p): int(k) for p, k in zip(packed, n) if k}


def test_near_copies_link(spark):
    """Texts of 2,000 words that differ in one are within the radius; others aren't; equal texts share a class."""
    text = [f"w{i * i % 1999}" for i in range(2000)]
    rows = [(i, " ".join([*text[:i], "changed", *text[i + 1 :]])) for i in range(5)] + [(20, " ".join(text)), (10, " ".join(text)), (30, "something else"), (40, "")]
    found = {r["doc_id"]: r for r in simhash.likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[20]["class_id"] == found[10]["class_id"] == 10 and found[20]["fingerprint"] == found[10]["fingerprint"]
    assert found[10]["n_links"] == 5 and found[30]["n_links"] == 0 and found[40]["fingerprint"] == "0" * 64


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert [r["fingerprint"] for r in simhash.fingerprints(df).orderBy("doc_id").collect()] == ["0" * 64, simhash.simhash([b"a b"])[0].hex()]
    with pytest.raises(ValueError):
        simhash.fingerprints(df.withColumn("Fingerprint", F.lit(1)))


# --- 13 fill in the middle --------------------------------------------------------


def _plain_cut(text, doc_id, pattern, rate, spm):
    units = re.findall(pattern, text)
    h = [int(x, 16) for x in re.findall("." * 8, H("7:", "" if doc_id is None else str(doc_id)))[:4]]
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


AWKWARD = [None, "", "\n", "\n\n\n", "no end", "a\nb\r\nc", "é😀\n\x00x\n", "has <P> in it", "<S\n<M\n<P", "<<P\n<S\nP>\n" * 9, "line\n" * 50_000, "x" * 300_000]


@pytest.mark.parametrize("pattern,rate,spm", [(fill_middle.LINES, 100, 50), (r"\s*\S+|\s+$", 60, 100), (fill_middle.LINES, 0, 0)])
def test_fill_middle(spark, pattern, rate, spm):
    rows = [(i, AWKWARD[i % len(AWKWARD)]) for i in range(4 * len(AWKWARD))] + [(None, "no id\nhere\n"), (3, "twice\nx"), (3, "twice\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("prefix", F.lit("kept"))
    made = fill_middle.transform(df, pattern, rate, spm)
    back = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    have = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["prefix"]) for r in back)
    assert have == Counter((i, t, *_plain_cut(t or "", i, pattern, rate, spm), "kept") for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in back)
    with pytest.raises(ValueError):
        fill_middle.transform(df.withColumn("FORM", F.lit(1)))


def test_the_matcher_is_lazy():
    """The second pass stops at the greater rank, and neither pass keeps units."""
    import tracemalloc

    pattern, text = re.compile(fill_middle.LINES), "ab\n" * 400_000
    tracemalloc.start()
    assert sum(1 for _ in fill_middle.units(pattern, text)) == 400_000
    assert fill_middle.offsets(pattern, text, 3, 399_999) == (9, 1_199_997)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    assert fill_middle.offsets(pattern, text, 0, 0) == (0, 0)
