"""Scores and neighbours against dense cosines over the whole vocabulary."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from roundsmith.llm import toxicity


def words(text):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def dense_scores(rows, labels, k=25):
    """(score, evidence cosines) of each row (doc_id, text); labels: {doc_id: toxic}. Plain dense arithmetic."""
    taught = {}
    for d, t in rows:
        if d in labels and zlib.crc32(str(d).encode()) % 4 != 2:
            taught.setdefault(t or "", {})[d] = labels[d]
    examples = sorted((min(own), float(np.mean(list(own.values()))), Counter(words(t))) for t, own in taught.items())
    vocabulary = sorted({w for _, _, c in examples for w in c})
    number = {w: i for i, w in enumerate(vocabulary)}
    bags = [Counter(w for w in words(t) if w in number) for _, t in rows]
    df = Counter(w for b in bags for w in b)
    toxic, other = Counter(), Counter()
    for _, y, c in examples:
        for w in c:
            toxic[w] += y
            other[w] += 1 - y
    weight = {w: (math.log((1 + len(rows)) / (1 + df[w])) + 1) * math.log2(2 + toxic[w] / max(other[w], 1)) for w in vocabulary}

    def vector(c):
        v = np.zeros(len(vocabulary))
        for w, n in c.items():
            v[number[w]] = (1 + math.log(n)) * weight[w]
        return v / (np.linalg.norm(v) or 1)

    full = [(y, vector(c)) for _, y, c in examples if c]
    bare = [y for _, y, c in examples if not c]
    rate = float(np.mean([y for _, y, _ in examples])) if examples else 0.0
    bare = (sum(bare) + rate) / (len(bare) + 1)
    table, y = np.array([v for _, v in full]), np.array([y for y, _ in full])

    def vote(v, without=None):
        cosines = table @ v
        if without is not None:
            cosines[without] = 0
        best = [i for i in np.argsort(-np.round(cosines, 12), kind="stable")[:k] if cosines[i] > 0]
        w = 1 / (1.1 - np.minimum(cosines[best], 1))
        return (float((w @ y[best] + bare) / (w.sum() + 1)) if best else bare), cosines[best]

    at, to = toxicity.isotonic(np.array([vote(v, i)[0] for i, (_, v) in enumerate(full)]), y)
    out = []
    for b in bags:
        if not b:
            out.append((bare, []))
            continue
        v, cosines = vote(vector(b))
        fit = to[np.searchsorted(at, v, "right") - 1] if v >= at[0] else min(v, to[0])
        out.append((min(1.0, max(0.0, float(fit))), cosines[:3]))
    return out


def corpus(seed, n=500):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)] + ["été", "Über", "don't"]
    rows = []
    for i in range(n):
        own = rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=rng.randrange(1, 60))
        rows.append((i, " ".join(own + (["Nasty", "vile!"] if i % 6 == 0 else []))))
    labels = {i: int(i % 6 == 0) if rng.random() < 0.95 else 1 - int(i % 6 == 0) for i in range(0, n, 2)}
    return rows, labels


def test_scores_equal_dense_arithmetic(spark):
    rows, labels = corpus(3)
    rows += [(None, "vile words"), (9001, ""), (9002, None), (9003, "word " * 300_000 + "w1 w2 vile"), (9004, "zzz yyy"), (7, "again w3 w4"), (8, rows[8][1]), (9005, rows[12][1])]
    docs = spark.createDataFrame([(d, t, 1.0, "x") for d, t in rows], "doc_id long, text string, score double, words string")
    table = spark.createDataFrame([(d, 1, y) for d, y in labels.items()] + [(None, 1, 1), (9001, 0, None)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.text_hash): r for r in toxicity.toxicity(docs, table).collect()}
    hashes = {(r.doc_id, r.text or ""): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    for (d, t), (score, cosines) in zip(rows, dense_scores(rows, labels)):
        r = got[d, hashes[d, t or ""]]
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.3), (d, r.score, score)
        np.testing.assert_allclose([e.cosine for e in r.evidence], cosines, atol=1e-9)
    assert toxicity.toxicity(docs, table.where("false")).where("score <> 0").count() == 0
    assert toxicity.toxicity(docs.where("false"), table).count() == 0


def test_block_maxima_spare_blocks_and_lose_no_neighbour():
    rng = np.random.default_rng(0)
    vectors = []
    for i in range(3000):
        t = np.unique(np.concatenate([rng.integers(0, 40, 10) + 40 * (i % 20), rng.integers(800, 900, 3)]))
        w = (rng.random(len(t)) + 0.1) * np.where(t < 800, 1, 0.1)
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, rng.integers(0, 2, 3000), list(range(3000)), 900)
    dense = np.zeros((3000, 900))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        rows, cosines = index.nearest(t, w, 25)
        np.testing.assert_allclose(np.sort(dense[:, t] @ w)[::-1][:25], cosines, atol=1e-9)
    assert index.read < 0.5 * index.asked
