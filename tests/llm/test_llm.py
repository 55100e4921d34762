"""The ten operators against brute force on small tables, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same  # noqa: E402

from waymark.llm import bpe_replay, chat_repair, cross_entropy, graph, itq_dedup, license_scan, minhash_dedup, mixing, ngram_rules, quality_lm, textops, toxicity_gbt  # noqa: E402
from waymark.llm import kneser_ney as kn  # noqa: E402
from waymark.llm import queries as own  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 1), (4, "same words here again and more", "en", None, 1), (5, "same words here again and more", None, "b", 1), (5, "same words here again and more", None, "b", 1), (None, "an id is missing", "xx", "b", 1), (6, "\x00\x01 é😀 \n\n\t x", "en", "", 1)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    df = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    for name in ("_lang", "_upper", "_bits", "_copy", "kept", "size", "score", "id", "hub", "key", "part", "component", "length_class", "fold", "upper", "copies"):
        df = df.withColumn(name, F.lit("other"))
    return df


@pytest.fixture
def spread(spark):
    """Keeps small partitions apart, as large data would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_oracles(spark, sf, name):
    same(own.queries()[name](spark, sf), connect(sf), own.oracle_sql()[name])


# --- words ------------------------------------------------------------------


def test_word_hashes():
    texts = [b"", b"  a\tb\x0bc \xc2\xa0d\r\n", b"A a", b"a" * 50, " ".join(f"x{i}" for i in range(5000)).encode()]
    hashes, bounds = textops.word_hashes(texts)
    want = [w for t in texts for w in t.split()]
    assert list(np.diff(bounds)) == [len(t.split()) for t in texts]
    assert len(set(hashes.tolist())) == len(set(want)) and len(hashes) == len(want)
    assert len({(w, h) for w, h in zip(want, hashes.tolist())}) == len(set(want))
    lowered, _ = textops.word_hashes([b"A a"], lower=True)
    assert lowered[0] == lowered[1]


def test_shingles():
    texts = [b"", b"a b", b"a b c d", b"a b c d e a b c d"]
    hashes, bounds = textops.shingle_hashes(*textops.word_hashes(texts), 4)
    assert list(np.diff(bounds)) == [0, 1, 1, 6]
    assert hashes[1] == hashes[2] == hashes[7] and len(set(hashes.tolist())) == 6


# --- 1 chat -----------------------------------------------------------------


def _cheapest(roles):
    best = {chat_repair.START: 0}
    for r in roles:
        now = {}
        for s, c in best.items():
            for cost, q, _, _ in chat_repair.moves(s, r):
                now[q] = min(now.get(q, 10**9), c + cost)
        best = now
    return min(c + chat_repair.END_COST[s] for s, c in best.items())


def test_chat_repair(spark, spread):
    random = np.random.default_rng(3)
    names = ["system", "user", "assistant", "tool", None, " User "]
    rows = [(c, t, names[random.integers(6)], f"t{t}") for c in range(40) for t in range(random.integers(1, 7))]
    rows += [(1000, t, names[random.integers(4)], "x") for t in range(400)]  # spans all partitions
    rows += [(None, 0, "assistant", None), (None, None, "user", ""), (7, 1, "user", "t1"), (7, 1, "user", "t1")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = defaultdict(list)
    for r in chat_repair.repair(turns).collect():
        out[r["conv_id"]].append(r)
    source = defaultdict(list)
    for r in rows:
        source[r[0]].append(r)
    assert sum(map(len, out.values())) == len(rows)
    assert len({r["position"] >> 40 for r in out[1000]}) > 1
    for conv, found in out.items():
        found.sort(key=lambda r: r["position"])
        order = sorted(source[conv], key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or ""))
        assert [r["role"] for r in found] == [r[2] for r in order]
        assert sum(r["cost"] for r in found) == _cheapest([chat_repair.role_class(r[2]) for r in order])
        text = "".join(r["piece"] for r in found)
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        state = chat_repair.START
        for role in roles:
            assert chat_repair.GAPS[state][chat_repair.ROLES.index(role)] == ()
            state = chat_repair.ROLES.index(role)
        assert state == chat_repair.ASSISTANT and text.count("<|end|>") == len(roles)
        assert text.replace("\n", "").count("t1") >= sum(r[3] == "t1" for r in order)
    assert chat_repair.repair(turns.limit(0)).count() == 0


def test_chat_does_not_depend_on_partitions(spark, spread):
    rows = [(i // 50, i % 50, ["user", "assistant", "system", "bot"][(i * 7) % 4], str(i)) for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    take = lambda: sorted(tuple(r) for r in chat_repair.repair(turns).drop("position").collect())
    one = take()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert take() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- 2, 3, 8 n-gram models --------------------------------------------------


def _plain_model(counts: Counter) -> dict:
    """Modified Kneser-Ney by its definition on tuples; returns p(last | before) for any tuple."""
    orders = [counts]
    for _ in range(kn.ORDER - 1):
        orders.insert(0, Counter(g[1:] for g in orders[0]))
    cuts = []
    for table in orders:
        n = Counter(table.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            made = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            cuts.append([min(max(d, 0.05), i - 0.05) for i, d in enumerate(made, 1)])
        else:
            cuts.append([0.5, 1.0, 1.5])
    after = [defaultdict(list) for _ in orders]
    for k, table in enumerate(orders):
        for g, c in table.items():
            after[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (kn.ALPHABET - 1)
        k = len(g) - 1
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda c: min(cuts[k][min(c, 3) - 1], c) if c else 0
        c = orders[k].get(g, 0)
        return (c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return p


def _logs(model, grams):
    """Log-probabilities of 4-grams from the arrays of a model, in one shard."""
    keys = np.array([((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in grams], dtype=np.int32)
    lower, *shards = model.shards(1 << 30)
    own, at = np.unique(keys, return_inverse=True)
    return kn._joined(own, lower, iter(shards))[at]


def test_kneser_ney(spark, docs):
    texts = docs.where("doc_id < 25")
    model = kn.fit(kn.count_ngrams(texts, "text"))
    counts: Counter = Counter()
    for r in texts.collect():
        symbols = [0] * 3 + [int(kn._TABLE[min(ord(c), 65535)]) for c in r["text"]]
        counts.update(tuple(symbols[i : i + 4]) for i in range(len(symbols) - 3))
    p = _plain_model(counts)
    random = np.random.default_rng(0)
    grams = [*list(counts)[:300], *map(tuple, random.integers(1, 64, (300, 4)).tolist())]
    for g, log in zip(grams, _logs(model, grams)):
        assert log == pytest.approx(math.log(p(g)), abs=2e-3)
    for c in random.integers(1, 64, (50, 3)).tolist() + [list(g[:3]) for g in list(counts)[:50]]:
        assert np.exp(_logs(model, [(*c, x) for x in range(1, 64)])).sum() == pytest.approx(1, abs=1e-3)


def test_scores_follow_model(spark, docs):
    model = kn.fit(kn.count_ngrams(docs.where("doc_id < 20"), "text"))
    scorer = kn.Scorer(spark, model)
    texts = ["abc", "", "\x00é", "x" * 10]
    for text, log in zip(texts, scorer.logs(texts)):
        symbols = [0] * 3 + [int(kn._TABLE[1 if c == "\0" else ord(c)]) for c in text]
        grams = list(zip(symbols, symbols[1:], symbols[2:], symbols[3:]))
        assert log == pytest.approx(sum(map(float, _logs(model, grams))) if grams else 0.0, abs=1e-3)


def test_shards(spark, docs, monkeypatch):
    """Many small shards score like one."""
    model = kn.fit(kn.count_ngrams(docs.where("doc_id < 20"), "text"))
    texts = [r["text"] for r in docs.where("doc_id between 15 and 30").collect()] + ["", "zzzzqqqq"]
    one = kn.Scorer(spark, model).logs(texts)
    monkeypatch.setattr(kn, "SHARD", 500)
    many = kn.Scorer(spark, model)
    assert len(many.parts) > 10 and np.allclose(many.logs(texts), one)


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, grams = len(words), Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, docs, labels):
    out = {r["doc_id"]: r for r in ngram_rules.quality_rules(docs).collect()}
    for d in docs.collect():
        r = out[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(d["text"])
        within = r["perplexity"] is not None and r["lower_perplexity"] is not None and r["lower_perplexity"] - 1e-9 <= r["perplexity"] <= r["upper_perplexity"] + 1e-9
        assert r["kept"] == (not r["base_failed"] and within)


def test_quality_rules_verdicts(spark):
    """Without labels the rules keep good texts of 50 words or more and drop junk."""
    sf = "/root/testdata/sf0.01"
    out = own.op2_ngram_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert out[out["quality"] == 1]["kept"].mean() > 0.99 and (~out[out["quality"] == 0]["kept"]).mean() > 0.9


def test_quality_rules_awkward(awkward):
    out = ngram_rules.quality_rules(awkward).collect()
    assert len(out) == len(AWKWARD)
    for r in out:
        if r["doc_id"] in (1, 2):
            assert r["n_words"] == 0 and r["perplexity"] is None and r["base_failed"] and not r["kept"]
    assert ngram_rules.quality_rules(awkward.limit(0)).count() == 0


def test_quality_classifier(spark, docs, labels):
    more = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{more}/labels.parquet")
    out = own.op3_quality_classifier(spark, more).join(known, "doc_id").toPandas()
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    assert good["kept"].mean() > 0.98 and (~bad["kept"]).mean() > 0.8
    kept = quality_lm.Classifier(docs, labels).keep(docs)
    assert kept.columns == docs.columns
    named = {r["doc_id"] for r in quality_lm.classify(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == named


def test_quality_classifier_awkward(spark, awkward, labels):
    trusted = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (4, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_lm.classify(awkward, trusted).collect()
    assert len(out) == len(AWKWARD) and all(not r["kept"] and r["perplexity"] is None for r in out if r["doc_id"] in (1, 2))
    assert [r["trusted"] for r in out if r["doc_id"] in (3, 4)] in ([True, False], [False, True])
    assert quality_lm.Classifier(awkward, trusted).keep(awkward).columns == awkward.columns
    assert all(r["kept"] == (r["doc_id"] not in (1, 2)) for r in quality_lm.classify(awkward, trusted.limit(0)).collect())
    assert quality_lm.classify(awkward.limit(0), trusted).count() == 0


def test_cross_entropy(spark, docs, awkward):
    target = docs.where("lang = 'de'")
    out = cross_entropy.cross_entropy_difference(docs, target).join(docs, "doc_id").groupBy((F.col("lang") == "de").alias("de")).agg(F.avg("score").alias("s")).collect()
    by = {r["de"]: r["s"] for r in out}
    assert by[True] < 0 < by[False]
    rows = cross_entropy.cross_entropy_difference(awkward, awkward.limit(0)).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] is None for r in rows if r["doc_id"] in (1, 2))
    uniform = next(r for r in rows if r["doc_id"] == 4)
    assert uniform["target_loss"] == pytest.approx(math.log(63), abs=1e-3)


# --- 4 mixing ---------------------------------------------------------------


def test_mixing(spark, sf, docs):
    rows = own.op4_mixing(spark, sf)
    again = own.op4_mixing(spark, sf)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    table = rows.join(docs, "doc_id").toPandas()
    assert (table["taken"] <= 2 * table["size"]).all()
    for _, group in table.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 2 * group["size"].max()
        assert group["target"].iloc[0] <= 2 * group["source_size"].iloc[0] + 1e-6
    assert table.groupby("source")["target"].first().sum() == pytest.approx(1.5 * table["size"].sum())


def test_mixing_one_hot_source(spark, spread):
    docs = spark.createDataFrame([(i, "a b c", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string").repartition(8)
    out = mixing.mix(docs).toPandas()
    assert len(out) == 3000
    for _, group in out.groupby("source"):
        assert abs((group["copies"] * group["size"]).sum() - group["target"].iloc[0]) <= 6
    made = mixing.apply_mix(docs, mixing.mix(docs))
    assert made.count() == out["copies"].sum() and made.columns == docs.columns


def test_mixing_awkward(awkward):
    out = mixing.mix(awkward).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["copies"] <= 2 for r in out)
    assert mixing.apply_mix(awkward, mixing.mix(awkward)).columns == awkward.columns
    assert mixing.mix(awkward.limit(0)).count() == 0
    assert all(r["copies"] == 0 for r in mixing.mix(awkward.where("doc_id <= 2")).collect())


# --- 5 embeddings -----------------------------------------------------------


def _links(ids, vectors, labels):
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], 1 << 40).min(1))
        if (least == component).all():
            return linked.sum(1), component
        component = least


def test_embeddings(spark):
    random = np.random.default_rng(1)
    base = random.standard_normal((60, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = []
    for i in range(1500):  # a third of all near one vector; a sixth exact copies of another
        k = 0 if i % 3 == 0 else 1 if i % 6 == 1 else int(random.integers(2, 60))
        noise = random.standard_normal(64) * (0.0 if k == 1 else random.choice([0.008, 0.012, 0.018, 0.024]))
        rows.append((i, (base[k] + noise).astype(np.float32).tolist(), k % 4))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    out = itq_dedup.link(vectors).toPandas().set_index("vec_id").sort_index()
    n, component = _links(*zip(*rows))
    assert (out["n_links"].values <= n).all() and out["n_links"].sum() >= 0.98 * n.sum()
    assert (out["component_id"].values == component).mean() > 0.99
    assert (out["kept"] == (out.index == out["component_id"])).all()


def test_embeddings_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (8, [2.0, 2.0], 1), (8, [2.0, 2.0], 1), (9, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0], 1), (10, [1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("vector", F.lit(2))
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in itq_dedup.link(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (None, 0, None, False)]
    assert out == sorted(want, key=str)
    assert itq_dedup.link(df.limit(0)).count() == 0


# --- 6 licences -------------------------------------------------------------


def test_licenses(spark, docs):
    filler = " ".join(f"filler{i}" for i in range(200))
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, f"{filler} {mit} {filler}"), (2, "RELEASED under the\nMIT license"), (3, mit.replace("restriction", "limits")), (4, "Released under the MIT"), (5, ""), (6, None), (7, " ".join(license_scan.normal(mit.encode()).decode().split()[:30])), (8, f"Licensed under CC BY-NC 4.0. {filler} Licensed under CC BY-NC 4.0.")]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(1, "mit"), (2, "mit-notice"), (3, "mit"), (8, "cc-by-nc-4-notice"), (8, "cc-by-nc-4-notice")]
    whole = next(r for r in found if r["doc_id"] == 1)
    assert (whole["first_word"], whole["end_word"], whole["containment"]) == (200, 267, 1.0)


def test_licenses_brute_force(spark, sf, docs):
    normal = lambda t: f" {b' '.join(license_scan.normal((t or '').encode()).split()).decode()} "
    want = {(d["doc_id"], name) for d in docs.collect() for name, t in license_scan.TEMPLATES.items() if normal(t) in normal(d["text"])}
    have = {(r["doc_id"], r["license"]) for r in own.op6_license_scan(spark, sf).where("containment = 1").collect()}
    assert have == want and want


# --- 7 toxicity -------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    out = own.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.95
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    import zlib

    assert (out["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out["doc_id"]]).all()


def test_held_out_labels_play_no_part(spark, docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity_gbt.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity_gbt.toxicity(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_awkward(spark, awkward, labels):
    some = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (some, some.limit(0), labels):
        out = toxicity_gbt.toxicity(awkward.select("doc_id", "text", "score"), known).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity_gbt.toxicity(awkward.limit(0), some).count() == 0


def test_isotonic():
    x, y = toxicity_gbt.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and np.interp(2.5, x, y) == pytest.approx(0.5)


# --- 9 near duplicates ------------------------------------------------------


def _components(texts, shingle, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark):
    random = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 420):  # copies of one text with 0 to 14 edits, among others
        words = list(base) if i % 2 else [f"d{i % 40}x{k}" for k in range(60)]
        for k in random.integers(0, len(words), int(random.integers(0, 15))):
            words[k] = f"e{random.integers(0, 1000)}"
        texts[i] = " ".join(words)
    texts |= {500: "Short TEXT", 501: "short text", 502: "", 503: None, 504: "one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, sizes = _components(texts, 4, 80)
    out = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df, shingle=4).collect()}
    assert {i: r["n_shingles"] for i, r in out.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())
    differ = [i for i in texts if out[i]["component_id"] != want[i]]
    assert len(differ) <= 2, differ


def test_tiles_and_hubs(spark, monkeypatch):
    """Small tiles give the same as one large one."""
    docs = spark.createDataFrame([(i, " ".join(f"a{k + (i % 5)}" for k in range(80)) + f" z{i}") for i in range(150)], "doc_id long, text string")
    take = lambda: sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect()))
    one = take()
    monkeypatch.setattr(minhash_dedup, "TILE_ROWS", 7)
    assert take() == one


def test_near_duplicates_awkward(awkward):
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(awkward).collect()), key=str)
    assert out == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (None, None, False)], key=str)
    assert minhash_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_graph(spark):
    random = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    used = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert found == {x: root(x) for x in used}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10 BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf, docs, bpe):
    path, pattern, plain = bpe
    out = {r["doc_id"]: r for r in own.op10_byte_bpe(spark, sf).collect()}
    for d in docs.collect():
        ids = plain.encode_ordinary(d["text"])
        r = out[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_bpe_awkward(spark, awkward, bpe):
    path, pattern, plain = bpe
    texts = ["aaaaaaa a    b\n\n\n  c\t\t", "<|endoftext|> x", "日本語テキスト😀😀 naïve\x1c\x1d x\x85y\xa0z", "$$$$$$$$$ ======== ''ss 've", " 　 ١٢٣ ½", "a" * 5000, "ab" * 3000, "\x00\x01", "é́́́"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (rows, awkward.select("doc_id", "text")):
        encoded = bpe_replay.encode(df, path, pattern, decoded=True)
        have = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in encoded.collect()), key=str)
        want = sorted(((r["doc_id"], plain.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in df.collect()), key=str)
        assert have == want
        back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe_replay.decode(encoded, path).collect()}
        assert all(back[r["doc_id"]] == (r["text"] or "").encode() for r in df.collect())
    assert bpe_replay.encode(awkward.limit(0), path, pattern).count() == 0


def test_bpe_memory_is_bounded(bpe, monkeypatch):
    path, pattern, plain = bpe
    encoder = bpe_replay.Encoder(bpe_replay.Vocabulary(bpe_replay.read_ranks(path), pattern))
    monkeypatch.setattr(bpe_replay, "MEMORY", 5)
    for text in ("one two three four five six", "seven eight one", "two"):
        ids, bounds = encoder.encode([text, ""])
        assert ids.tolist() == plain.encode_ordinary(text) and bounds.tolist() == [0, len(ids), len(ids)]
