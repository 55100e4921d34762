"""The pipeline, the features of toxicity and its trees against plain versions written apart."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline as cp
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_plain import _scores

from waymark.llm import bpe_replay, mixing, quality_lm
from waymark.llm import kneser_ney as kn
from waymark.llm import toxicity_gbt as T

# --- the pipeline --------------------------------------------------------------------


def _corpus():
    """(rows, quality, toxic): prose, garbage, abuse, and near and exact copies of prose."""
    random = np.random.default_rng(12)
    syllables = ["ba", "ri", "lo", "men", "tu", "sha", "kel", "dor", "vi", "pan"]
    words = ["".join(random.choice(syllables, random.integers(2, 5))) for _ in range(400)]
    sources = ["a", "b", "c", "d", None]
    prose = lambda: list(random.choice(words, int(random.integers(60, 110))))
    rows, quality, toxic = [], {}, {}

    def add(text, good, bad, labelled=True):
        i = len(rows)
        rows.append((i, text, "en", sources[int(random.integers(0, 5))], len(text)))
        if labelled:
            quality[i], toxic[i] = good, bad
        return i

    for _ in range(110):
        add(" ".join(prose()), 1, 0)
    for _ in range(50):
        own = prose()
        for at in random.choice(len(own), 8, replace=False):
            own[at] = ["vilbaton", "dormenkel", "shatuvi"][int(random.integers(0, 3))]
        own[5:5] = ["you", "vilbaton", "dormenkel", "shatuvi"]
        add(" ".join(own), 1, 1)
    for _ in range(30):
        add(" ".join("".join(random.choice(list("qxzwjf"), 7)) for _ in range(80)), 0, 0)
    for i in range(0, 40, 2):
        own = rows[i][1].split()
        own[int(random.integers(0, len(own)))] = "menlo"
        add(" ".join(own), 1, 0, labelled=False)
        add(rows[i][1], 1, 0, labelled=False)
    for i in range(60, 80):  # far copies: half of the words are others
        own = rows[i][1].split()
        add(" ".join(own[: len(own) // 2] + prose()), 1, 0, labelled=False)
    return rows, quality, toxic


def _good(rows, quality, side):
    """Ids within the threshold, and how near to it the nearest log-perplexity lies."""
    text = {r[0]: r[1] for r in rows}
    trusted = [i for i, q in quality.items() if q]
    found = []
    for h in (0, 1):
        mine = [i for i in trusted if side[i] == h]
        found += [-s / len(text[i]) for i, s in zip(mine, _scores([text[i] for i in trusted if side[i] != h], [text[i] for i in mine]))]
    grid = sorted(math.floor(v / kn.GRID) for v in found)
    middle, far = (grid[math.ceil(q * len(grid)) - 1] for q in (0.5, quality_lm.LEVEL))
    limit = (middle + quality_lm.REACH * (far - middle)) * kn.GRID
    final = {i: -s / len(text[i]) for i, s in zip(text, _scores([text[i] for i in trusted], list(text.values())))}
    return {i for i, v in final.items() if v <= limit}, min(abs(v - limit) for v in final.values())


def _classes(text):
    """Least id of each class of near copies: five-word shingles, all pairs."""
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in text.items()}
    low = {i: i for i in text}
    links = [(a, b) for a in grams for b in grams if a < b and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_pipeline_by_hand(spark, tmp_path):
    rows, quality, toxic = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, quality[i], toxic[i]) for i in quality]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    side = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality_lm.half("doc_id").alias("h")).collect()}
    kept, room = _good(rows, quality, side)
    assert room > 1e-3 and {i for i, q in quality.items() if not q}.isdisjoint(kept)
    harmless = {i for i in kept if not re.search("vilbaton|dormenkel|shatuvi", rows[i][1])}
    assert len(kept) - len(harmless) > 40
    low = _classes({i: rows[i][1] for i in harmless})
    single = sorted(i for i in harmless if low[i] == i)
    assert len(harmless) - len(single) >= 38
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, rows[i][1], rows[i][3]) for i in single])
    copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall()}
    ranks = {t: i for i, t in enumerate(bpe_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i in single:
        ids = plain.encode_ordinary(rows[i][1])
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(rows[i][1].encode()))] += copies[i]
    have = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, str(tmp_path)).collect())
    assert have == +want and max(have.values()) == 2 and len(have) < len(want)


# --- 7 toxicity ----------------------------------------------------------------------


def _plain_features(text: str, lexicon: dict[str, float], beginnings: dict[bytes, float]) -> list[float]:
    """Of a text of ASCII and Latin-1 letters, by the definitions of the names."""
    found = list(re.finditer("[A-Za-zÀ-ÖØ-öø-ÿ]+", text))
    raw = [m.group() for m in found]
    words, size = [w.lower() for w in raw], len(text.encode())
    of = lambda w: max([lexicon.get(w, 0.0), *(beginnings.get(w.encode()[:k], 0.0) for k in T.PREFIXES if len(w.encode()) > k)])
    weight = [of(w) for w in words]
    said = [i for i, x in enumerate(weight) if x > 0]
    meant = [i for i, w in enumerate(words) if w in T.SECOND_PERSON]
    n, letters = max(len(words), 1), max(sum(len(w.encode()) for w in words), 1)
    among = lambda chars: sum(text.count(c) for c in chars)
    near = lambda a, b: 0 < b.start() - a.end() <= 3 and not re.search(r"[\s'-]", text[a.end() : b.start()])
    odd = hidden = 0
    for i in range(len(found) - 1):
        if near(found[i], found[i + 1]) and not (i and near(found[i - 1], found[i])):
            odd += 1
            blank = max([text.rfind(c, 0, found[i + 1].start()) for c in " \n\t"])
            begin = max(blank + 1, found[i - 1].end() if i else 0)
            whole = re.match(r"\S*", text[begin:]).group().lower()
            swapped = whole.translate(str.maketrans("013457@$", "oieastas"))
            for read in (swapped, whole):
                hidden += "".join(re.findall("[a-zÀ-ÖØ-öø-ÿ]", read)) in lexicon
    return [
        len(said), sum(weight), max([0.0, *weight]), 100 * len(said) / n, 100 * len(meant) / n,
        max([0.0, *(math.exp(-abs(a - b) / 5) for a in said for b in meant)]),
        len(re.findall("[A-Z]", text)) / letters, sum(bool(re.fullmatch("[A-Z]{2,}", w)) for w in raw) / n,
        among("!") / n, among("?") / n, among(".,;:!?") / n, among("#*$%&|<>@_~^") / max(size, 1), among("0123456789") / max(size, 1),
        odd / n, hidden, math.log1p(n), letters / n,
    ]


def test_features_by_definition():
    random = np.random.default_rng(5)
    lexicon = {"dummkopf": 3.0, "idiot": 2.5, "crétin": 4.0, "loser": 2.25}
    beginnings = {b"stup": 2.0, b"wretch": 3.5}
    pool = ["you", "Your", "vous", "DU", "IDIOT", "idiot", "Dummkopf", "crétin", "CRÉTIN", "loser", "stupid", "Stupidity", "stup", "wretched", "house", "Tree", "é", "x", "1d10t", "l0s3r", "i.d.i.o.t", "lo*ser!", "it's", "well-known", "a@b", "!!!", "?", "#tag", "100%", "co.uk,", "A", "NASA", "los3r?", "(idiot)", "w8", "o1o"]
    texts = ["", "you", "idiot"] + [" ".join(random.choice(pool, int(random.integers(1, 60)))).replace(" x ", "\n") for _ in range(300)]
    keys = [(int(T._hash([w.encode()])[0]), x) for w, x in lexicon.items()]
    keys += [(int(T._hash([w])[0]) ^ len(w), x) for w, x in beginnings.items()]
    keys.sort()
    sorted_lexicon = np.array([k for k, _ in keys], dtype=np.uint64), np.array([x for _, x in keys])
    have = T.features([t.encode() for t in texts], sorted_lexicon)
    want = np.array([_plain_features(t, lexicon, beginnings) for t in texts])
    for j, name in enumerate(T.NAMES):
        wrong = np.flatnonzero(~np.isclose(have[:, j], want[:, j]))
        assert not len(wrong), (name, texts[wrong[0]], have[wrong[0], j], want[wrong[0], j])
    assert (want.max(axis=0) > 0).all()


def _boosted(x, y, rounds, depth, rate, bins=64):
    """Raw scores by recursion: every edge of every feature is tried in every node."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    total = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)

    def grow(rows, level, g, h):
        best, split = 1e-9, None
        for j in range(x.shape[1]) if level < depth else ():
            for e in edges[j]:
                left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                if h[left].sum() >= 1 and h[right].sum() >= 1:
                    made = gain(g[left], h[left]) + gain(g[right], h[right]) - gain(g[rows], h[rows])
                    if made > best + 1e-12:
                        best, split = made, (left, right)
        if split is None:
            total[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
        else:
            for part in split:
                grow(part, level + 1, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grow(np.arange(len(y)), 0, y - p, p * (1 - p))
    return total


def test_trees_by_definition():
    random = np.random.default_rng(11)
    x = random.standard_normal((160, 4))
    x[:, 3] = random.integers(0, 4, 160)
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0.3)) | (x[:, 3] == 2)).astype(float)
    have = T.Trees(depth=3).fit(x, y, rounds=5, rate=0.3).raw(x)
    assert have == pytest.approx(_boosted(x, y, 5, 3, 0.3), abs=1e-9)


def test_labels_of_the_fold_out_of_training(spark):
    """Scores come from rows outside the held-out fifth alone, whatever its labels and texts say."""
    rows = [(i, ("you vilbaton dormenkel " if i % 3 == 0 else "a quiet river ") * 4 + f"n{i}", int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    held = T.fold(F.col("doc_id")) == 0
    some = T.toxicity(docs, labels.where(~held)).collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, T.toxicity(docs, labels).collect()))
    truth = {i: t for i, _, t in rows}
    out = [r for r in some if r["held_out"]]
    assert len(out) > 20 and all(r["predicted"] == truth[r["doc_id"]] for r in out)
