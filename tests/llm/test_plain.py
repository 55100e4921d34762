"""Operators against plain versions written apart from them, and past former limits."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe_replay, chat_repair, cross_entropy, itq_dedup, license_scan, minhash_dedup, ngram_rules, quality_lm, toxicity_gbt
from waymark.llm import kneser_ney as kn

CLASHING = ("_lang", "_bits", "conv", "tie", "row", "part", "kept", "score", "id", "key", "fold", "half", "license", "ids", "decoded", "piece", "position", "cost")


def clash(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("other"))
    return df


# --- 1 chat -----------------------------------------------------------------


def _inserted(roles: str) -> int:
    """Fewest messages that make a sequence legal: nothing, or s? and then user, assistant in turn."""
    best = 0 if not roles else 10**6
    for m in range(1, len(roles) + 2):
        for legal in ("ua" * m, "s" + "ua" * m):
            rest = iter(legal)
            if all(r in rest for r in roles):
                best = min(best, len(legal) - len(roles))
    return best


def _least_cost(turns: str) -> int:
    """Over all ways to merge and label each turn; ? is an unknown role."""
    best = 10**6
    for labels in itertools.product("suam", repeat=len(turns)):
        if labels[0] == "m":
            continue
        cost, made = 0, ""
        for turn, label in zip(turns, labels):
            if label == "m":
                cost += 1
            else:
                made += label
            cost += 0 if made[-1] == turn else 2 if turn == "?" else 3
        best = min(best, cost + 2 * _inserted(made))
    return best


def test_repairs_by_enumeration(spark):
    names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    every = ["".join(t) for n in (1, 2, 3, 4) for t in itertools.product("sua?", repeat=n)]
    rows = [(i, t, names[r], f"text {t}") for i, turns in enumerate(every) for t, r in enumerate(turns)]
    out = chat_repair.repair(clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    cost = {r["conv_id"]: r["c"] for r in out.groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()}
    assert {t: cost[i] for i, t in enumerate(every)} == {t: _least_cost(t) for t in every}


def test_repair_of_long_and_null_conversations(spark):
    rows = [(None, t, ["user", "assistant"][t % 2], "x") for t in range(300)] + [(1, 0, "user", "y" * 3_000_000), (1, 1, "assistant", None)]
    out = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert len(out) == 302 and sum(r["cost"] for r in out) == 0 and max(len(r["piece"]) for r in out) > 3_000_000


# --- 2, 3 quality -------------------------------------------------------------


def _scores(own: list[str], scored: list[str]) -> list[float]:
    """Log-probabilities by a plain modified Kneser-Ney model of folded characters."""
    fold = lambda t: [0, 0, 0, *(int(kn._TABLE[ord(c)]) for c in t)]
    grams = lambda t: list(zip(t, t[1:], t[2:], t[3:]))
    orders = [Counter(g for t in own for g in grams(fold(t)))]
    for _ in range(3):
        orders.insert(0, Counter(g[1:] for g in orders[0]))
    cuts, after = [], [defaultdict(list) for _ in orders]
    for k, table in enumerate(orders):
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cuts.append([min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)] if all(n[i] for i in (1, 2, 3, 4)) else [0.5, 1.0, 1.5])
        for g, c in table.items():
            after[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 63
        k, seen = len(g) - 1, after[len(g) - 1].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda c: min(cuts[k][min(c, 3) - 1], c) if c else 0
        c = orders[k].get(g, 0)
        return (c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return [sum(math.log(p(g)) for g in grams(fold(t))) for t in scored]


def test_classifier_by_definition(spark):
    random = np.random.default_rng(4)
    words = ["river", "house", "stone", "tree", "old", "the", "of", "by", "stands", "little"]
    rows = [(i, " ".join(random.choice(words, 60)) + "." * (i % 3), "en") for i in range(70)]
    rows += [(100 + i, " ".join(f"zq{x}xv" for x in random.integers(0, 99, 60)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    side = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality_lm.half("doc_id").alias("h")).collect()}
    text = {i: t for i, t, _ in rows}
    ppl = {}
    for h in (0, 1):
        mine = [i for i in range(50) if side[i] == h]
        for i, log in zip(mine, _scores([text[i] for i in range(50) if side[i] != h], [text[i] for i in mine])):
            ppl[i] = -log / len(text[i])
    grid = sorted(math.floor(v / kn.GRID) for v in ppl.values())
    middle, far = grid[math.ceil(0.5 * 50) - 1], grid[math.ceil(quality_lm.LEVEL * 50) - 1]
    limit = (middle + quality_lm.REACH * (far - middle)) * kn.GRID
    final = [-s / len(t) for s, t in zip(_scores([text[i] for i in range(50)], list(text.values())), text.values())]
    out = {r["doc_id"]: r for r in quality_lm.classify(docs, labels).collect()}
    for (i, _), v in zip(text.items(), final):
        assert math.log(out[i]["perplexity"]) == pytest.approx(v, abs=1e-4)
        assert math.log(out[i]["threshold"]) == pytest.approx(limit, abs=3 * kn.GRID)
        if abs(v - limit) > 1e-3:
            assert out[i]["kept"] == (v <= limit)
    assert not any(out[100 + i]["kept"] for i in range(10))


def test_both_bands_reject(spark):
    """Monotonous and garbled texts that pass the base rules lie outside the band; texts with
    many symbols are counted like all others."""
    random = np.random.default_rng(8)
    syllables = ["ba", "ri", "lo", "men", "tu", "sha", "kel", "dor", "vi", "pan"]
    words = ["".join(random.choice(syllables, random.integers(2, 5))) for _ in range(4000)]
    rows = [(i, " ".join(random.choice(words, 300)), "en") for i in range(200)]
    low = " ".join(random.choice(syllables) + (random.choice(syllables) if random.random() < 0.4 else "") for _ in range(300))
    odd = " ".join("".join(random.choice(list("qxzwkjvf"), 7)) for _ in range(300))
    rows += [(900, low, "en"), (901, odd, "en"), (902, " ".join(f"{w} |" for w in random.choice(words, 300)), "en")]
    out = {r["doc_id"]: r for r in ngram_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in out.values()) and sum(out[i]["kept"] for i in range(200)) >= 198
    assert out[900]["perplexity"] < out[900]["lower_perplexity"] and out[901]["perplexity"] > out[901]["upper_perplexity"]
    assert [out[i]["kept"] for i in (900, 901, 902)] == [False, False, False]


# --- 6 licences ---------------------------------------------------------------


def test_license_recall_at_the_threshold(spark):
    """Worn templates between other words: none at or over 0.8 is missed, each match holds."""
    random = np.random.default_rng(6)
    templates = {n: t for n, t in license_scan.TEMPLATES.items() if len(t.split()) > 30}
    rows, i = [], 0
    for text in templates.values():
        for edits in range(0, 9):
            for _ in range(6):
                words = license_scan.normal(text.encode()).decode().split()
                for at in random.integers(0, len(words), edits):
                    words[at] = f"worn{at}"
                noise = [f"n{x}" for x in random.integers(0, 10**6, int(random.integers(0, 120)))]
                rows.append((i, " ".join(noise + words + noise[::-1])))
                i += 1
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    plain = {n: license_scan.normal(t.encode()).decode().split() for n, t in templates.items()}
    want = {(d, n) for d, t in rows for n, ws in plain.items() if len(grams(ws) & grams(t.split())) >= 0.8 * len(grams(ws))}
    out = license_scan.scan_licenses(clash(spark.createDataFrame(rows, "doc_id long, text string")), templates).collect()
    assert {(r["doc_id"], r["license"]) for r in out} == want and len(want) > 60
    texts = dict(rows)
    for r in out:
        span = texts[r["doc_id"]].split()[r["first_word"] : r["end_word"]]
        assert r["containment"] == pytest.approx(len(grams(plain[r["license"]]) & grams(span)) / len(grams(plain[r["license"]])))


def test_license_awkward(spark):
    one = "Released under the MIT License."
    rows = [(None, one), (1, None), (2, ""), (3, one), (3, one), (4, "w " * 400_000 + one)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r["doc_id"], r["license"], r["first_word"]) for r in license_scan.scan_licenses(df).collect()), key=str)
    assert found == sorted([(None, "mit-notice", 0), (3, "mit-notice", 0), (3, "mit-notice", 0), (4, "mit-notice", 400_000)], key=str)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_many_like_templates(spark):
    """Templates with minhashes in common, under two names too, are each found; none, no matches."""
    base = [f"clause{i} of the licence that grants use and takes away warranty{i % 7} for all time{i // 3}" for i in range(40)]
    templates = {f"t{i}": text for i, text in enumerate(base)} | {f"again{i}": text for i, text in enumerate(base)}
    templates |= {f"longer{i}": f"{text} and one more" for i, text in enumerate(base)}
    rows = [(i, f"before it {text} and after") for i, text in enumerate(base)] + [(100, " ".join(f"{t} x{k}" for k, t in enumerate(base)))]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(d, n) for d, text in rows for n, t in templates.items() if len(grams(t) & grams(text)) >= 0.8 * len(grams(t))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs, templates).collect()} == want
    assert len(want) >= 240
    assert license_scan.scan_licenses(docs, {}).count() == 0


def test_parts_of_licences(spark):
    """A later part alone, with other line breaks and comment signs, names its licence."""
    part = lambda name: "\n# ".join(license_scan.TEMPLATES[name].split())
    names = ["mit-warranty", "bsd-warranty", "apache-2-grant", "zlib", "lgpl-2.1-header", "agpl-3-header", "epl-2-header", "cc0-notice"]
    rows = [(i, f"some code here\n# {part(name)}\nmore code") for i, name in enumerate(names)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == list(enumerate(names))


# --- 7 toxicity -----------------------------------------------------------------


def test_isotonic_by_definition():
    random = np.random.default_rng(0)
    for _ in range(20):
        score, y = random.integers(0, 12, 40).astype(float), random.integers(0, 2, 40).astype(float)
        points = sorted(set(score.tolist()))
        sums = [(y[score == s].sum(), (score == s).sum()) for s in points]
        mean = lambda i, j: sum(a for a, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1])
        curve = toxicity_gbt.isotonic(score, y)
        for i, s in enumerate(points):
            want = max(min(mean(j, k) for k in range(i, len(points))) for j in range(i + 1))
            assert np.interp(s, *curve) == pytest.approx(want)


def test_first_split_by_search():
    random = np.random.default_rng(1)
    x = random.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (random.random(300) < 0.15)).astype(float)
    tree = toxicity_gbt.Trees(depth=1).fit(x, y, rounds=1, rate=1.0)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    best = max(((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1), j, t) for j in range(3) for t in range(8) for m in [x[:, j] <= t]))
    assert tree.feature[0][0] == best[1] and (x[:, best[1]] <= tree.threshold[0][0]).tolist() == (x[:, best[1]] <= best[2]).tolist()
    left = x[:, best[1]] <= best[2]
    for side, value in zip((left, ~left), tree.value[0]):
        assert value == pytest.approx(g[side].sum() / (h[side].sum() + 1))


def test_a_lexicon_of_any_size(spark):
    """3,000 words that only toxic texts have, each in 2 of 3 of them, are all in the lexicon."""
    random = np.random.default_rng(2)
    bad = [f"v{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(3000)]
    rows = [(f"{' '.join(random.permutation(bad)[:2000])}" if i % 2 else f"plain text number {i}", i % 2, int(i > 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, toxic int, half int").repartition(4)
    sizes = {0: [16, 15], 1: [14, 15]}
    whole, _, _ = toxicity_gbt.lexicons(df, sizes)
    assert set(toxicity_gbt._hash([w.encode() for w in bad]).tolist()) <= set(whole[0].tolist())


def test_obfuscated_words_of_any_length():
    word = b"a" + b"b" * 500
    lexicon = np.sort(toxicity_gbt.Words([b"ababab", word]).words), np.ones(2)
    texts = [b"4b4b4b x", b"a-b-a", b"a.b.a.b.a.b and more", b"ab " * 5, b"a*" + b"b" * 500, b"a*" + b"b" * 499]
    count, hidden = toxicity_gbt._obfuscated(toxicity_gbt.Words(texts), lexicon)
    assert count.tolist() == [1, 0, 1, 0, 1, 1] and hidden.tolist() == [1, 0, 2, 0, 2, 0]


def test_toxicity_with_clashing_columns(spark, sf):
    docs = clash(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity_gbt.toxicity(docs, labels).count() == 40
    assert toxicity_gbt.keep_harmless(docs, labels).columns == docs.columns


# --- 5, 8, 9, 10 ------------------------------------------------------------------


def test_tables_of_three_chunks(spark):
    random = np.random.default_rng(3)
    base = random.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + random.standard_normal(32) * 0.02).tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    two, three = (sorted(map(tuple, itq_dedup.link(df, of=n).collect())) for n in (2, 3))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = int((x @ x.T >= 0.98).sum() - 400)
    assert sum(r[1] for r in two) >= 0.99 * links and sum(r[1] for r in three) >= 0.95 * links


def test_cross_entropy_empty_and_clashing(spark):
    rows = [(1, "a b c a b"), (1, "a b c a b"), (None, "c b")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    out = cross_entropy.cross_entropy_difference(df, df).collect()
    assert len(out) == 3 and all(abs(r["score"]) < 1e-9 for r in out)
    assert cross_entropy.cross_entropy_difference(df.limit(0), df.limit(0)).count() == 0


def test_recall_just_over_the_threshold(spark):
    random = np.random.default_rng(9)
    rows, close = [], 0
    for i in range(300):
        words = [f"p{i}w{k}" for k in range(int(random.integers(60, 200)))]
        worn, edits = list(words), 0
        sets = lambda ws: {tuple(ws[k : k + 4]) for k in range(len(ws) - 3)}
        while True:
            tried = list(worn)
            tried[int(random.integers(0, len(words)))] = f"e{i}x{edits}"
            a, b = sets(words), sets(tried)
            if 100 * len(a & b) < 80 * len(a | b):
                break
            worn, edits = tried, edits + 1
        a, b = sets(words), sets(worn)
        close += len(a & b) / len(a | b) < 0.85
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(worn))]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=4)
    assert close > 250 and out.where("not kept").count() >= 0.99 * 300


def test_wide_buckets_are_tiled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"a{k + (i % 7)}" for k in range(60)) + f" z{i} y{i % 11}") for i in range(120)], "doc_id long, text string")
    take = lambda: sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect()))
    one = take()
    monkeypatch.setattr(minhash_dedup, "PAIRED", 1)
    assert take() == one


def test_bpe_with_clashing_columns(spark):
    import public_tokenizers

    df = clash(spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string"))
    out = bpe_replay.digests(bpe_replay.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 2] and re.fullmatch("[0-9a-f]{64}", out.first()["ids_sha256"])
