"""Toxicity against a plain version with loops and dense matrices, and rows of a crowded key."""
import random
from collections import Counter

import numpy as np

from pairwright.llm import op6_exact, op7_toxicity

WORD = (1 << 64) - 1


def plain_buckets(word):
    h = [ord(c) + 1 for c in f"<{word}>"]
    found = []
    for n in op7_toxicity.GRAMS:
        for i in range(len(h) - n + 1):
            g = 0
            for c in h[i : i + n]:
                g = (g * 1_000_003 + c) & WORD
            found.append(g * (2 * n + 1) & WORD)
    found.append(sum(c * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(h)) & WORD)
    mixed = []
    for g in found:
        g = (g ^ g >> 29) * 0xBF58476D1CE4E5B9 & WORD
        mixed.append((g ^ g >> 32) % op7_toxicity.BUCKETS)
    return mixed


def plain_scores(texts, y, others):
    """Training and scores with one dense row of bucket shares per text, in doubles; all weights one."""
    o = op7_toxicity
    bags = [Counter(w for w in (o.plain(x) for x in t.split()) if w) for t in texts]
    seen, total = np.zeros((2, o.BUCKETS)), [0, 0]
    for bag, k in zip(bags, y):
        total[k] += len(bag)
        for w in bag:
            for g in plain_buckets(w):
                seen[k, g] += 1
    both = seen.sum(axis=0) / sum(total)
    z = np.abs(seen[1] / total[1] - seen[0] / total[0]) / (np.sqrt(both * (1 / total[0] + 1 / total[1])) + 1e-12)
    z[seen.sum(axis=0) < o.LEAST_TEXTS] = 0
    chosen = np.flatnonzero((z > 0) & (z >= np.sort(z)[-o.MOST_BUCKETS]))
    trust, at = z[chosen] ** 4 / (z[chosen] ** 4 + o.SHRINK**4), {b: i for i, b in enumerate(chosen.tolist())}

    def row(words):
        x, n = np.zeros(len(chosen)), sum(words.values())
        for w, c in words.items():
            grams = plain_buckets(w)
            for g in grams:
                if g in at:
                    x[at[g]] += c / n / len(grams)
        return x

    x = np.array([row(b) for b in bags])
    scale = 1 / np.sqrt((x**2).sum(axis=1)[x.any(axis=1)].mean())
    prior = y.mean()
    weight = np.where(y == 1, min(1.0, o.MOST_PRIOR * (1 - prior) / (prior * (1 - o.MOST_PRIOR))), 1.0)
    prior = min(prior, o.MOST_PRIOR)
    bias0 = np.log((prior + 1e-4) / (1 - prior + 1e-4))
    rng = np.random.default_rng(o.SEED)
    params = [rng.normal(0, 1e-3, (len(chosen), o.DIMENSION)), np.zeros((o.DIMENSION, 2)), np.array([0.0, bias0])]
    params[1][:, 1] = rng.normal(0, 1, o.DIMENSION)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    features, target = x * trust * scale, np.eye(2)[y]
    for step in range(1, o.EPOCHS + 1):
        means = features @ params[0]
        e = np.exp(means @ params[1] + params[2])
        wrong = (e / e.sum(axis=1, keepdims=True) - target) * (weight / len(y))[:, None]
        grads = [features.T @ wrong @ params[1].T + o.DECAY * params[0], means.T @ wrong, wrong.sum(axis=0)]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - o.RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    out = []
    for t in others:
        words = [o.plain(w) for w in t.split()]
        logit = params[2] + (row(Counter(w for w in words if w)) * sum(1 for w in words if w) / max(1, len(words)) * trust * scale) @ params[0] @ params[1]
        out.append(1 / (1 + np.exp(logit[0] - logit[1])))
    return out


def test_toxicity_against_a_plain_version():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(200)] + ["Ünder", "ß", "(x)", "..."]
    make = lambda bad: " ".join(rng.choices(words, k=rng.randint(3, 40)) + rng.choices(["wubbaz", "Wubbazes!", "xwubbaz"], k=2 * bad))
    y = np.array([int(i % 3 == 0) for i in range(120)])
    texts = [make(b) for b in y]
    others = texts[:30] + [make(i % 2) for i in range(30)] + ["", "  ", "... !", "wubbazing"]
    got = op7_toxicity.Scorer(op7_toxicity.fit(texts, y, np.ones(len(y))))(others)
    assert np.allclose(got, plain_scores(texts, y, others), atol=5e-3)


def test_rows_of_a_crowded_key_stay_once(spark):
    rows = [(1, "hot  text")] * 300 + [(1, "hot text")] * 20 + [(None, "hot text")] * 90 + [(2, "hot text")] * 60 + [(None, None)] * 80 + [(i, f"t{i}") for i in range(10, 60)] * 2
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, row string").repartition(5)
    got = sorted(((r.doc_id, (r.text or "").replace("  ", " "), r.row) for r in op6_exact.stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "hot text", "en"), (None, "", "en")] + [(i, f"t{i}", "en") for i in range(10, 60)], key=str)
