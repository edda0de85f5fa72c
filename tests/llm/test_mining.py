"""Hard negatives, repeated substrings and spelling variants against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import op11_negatives, op12_substrings, op13_spelling

VECTORS = "vec_id long, label int, embedding array<float>, leaf string"  # `leaf` clashes with a name inside


def brute_negatives(rows):
    v = sorted({(i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)) for i, y, e, _ in rows if None not in (i, y, e) and None not in e and np.isfinite(np.array(e, np.float32)).all()})
    size = Counter(len(q) for *_, q in v)
    d = min(size, key=lambda k: (-size[k], k))
    v = [r for r in v if len(r[2]) == d]
    out = []
    for a in v:
        if a[0] % 50:
            continue
        others = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in v if r != a)
        for s, p, _ in [o for o in others if o[2] == a[1]][:5]:
            fit = [o for o in others if o[2] != a[1] and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(a[0], p, k + 1, o[1], -s, -o[0]) for k, o in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, spread, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6))
    return [(i, int(rng.integers(0, 4)), (scale * (centres[i % 8] + spread * rng.normal(size=6))).astype(np.float32).tolist(), "x") for i in range(n)]


@pytest.mark.parametrize("spread, scale", [(1.0, 0.2), (0.05, 1.0), (0.4, 2e5), (0.0, 1.0)])
def test_negatives(spark, monkeypatch, spread, scale):
    monkeypatch.setattr(op11_negatives, "LEAF_ROWS", 60)
    monkeypatch.setattr(op11_negatives, "EXACT", 16)
    rows = vectors(4, 420, spread, scale)
    rows += [(9, 1, [float("nan")] * 6, "x"), (50, 2, None, "x"), (51, None, [1.0] * 6, "x"), (None, 1, [1.0] * 6, "x"), (52, 1, [1.0, None] + [0.0] * 4, "x"), (53, 1, [1.0] * 3, "x"), (54, 1, [], "x")]
    rows += [(100, 1, [0.5] * 6, "y"), (100, 2, [0.5] * 6, "y"), *rows[:30]]  # an id of several rows; repeated rows
    got = op11_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and (len(want) > 20 or spread == 0)


def test_negatives_of_huge_components(spark):
    rows = vectors(6, 120, 0.5, 5e5) + [(200 + i, i % 3, [1e30] * 6, "x") for i in range(9)]  # scores beyond a long leave the last out
    got = op11_negatives.mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows[:120]) != []


def test_negatives_of_few_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert op11_negatives.mined(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0, 2.0], "x")], VECTORS)
    assert op11_negatives.mined(one, F.col("vec_id") % 50 == 0).count() == 0


def test_tree_skips_what_its_ranges_exclude():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 10
    rows = (centres[rng.integers(0, 40, 8000)] + 0.1 * rng.normal(size=(8000, 16)))
    tree = op11_negatives.SplitTree(rows, 200)
    asked = rows[:50]
    far = np.sqrt(((asked[:, None] - rows[None]) ** 2).sum(axis=2))
    inner, outer = np.full(50, 20.0), np.full(50, 25.0)
    met = np.zeros((50, len(rows)), bool)
    for leaf, who in tree.meet(asked, lambda s: inner[s], lambda s: outer[s]):
        met[np.ix_(who, tree.leaves[leaf])] = True
    assert met[(far >= inner[:, None]) & (far <= outer[:, None])].all()
    assert met.mean() < 0.4  # the rest of the leaves isn't met


def brute_repeats(docs, least):
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in docs]
    order = lambda d: (1 << 63) if d is None else d
    first = {}
    for d, w in words:
        for i in range(len(w) - least + 1):
            k = tuple(w[i : i + least])
            first[k] = min(first.get(k, 1 << 64), order(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] < order(d):
                gone[i : i + least] = [True] * least
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated_texts(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdé") for _ in range(r.randint(3, 30))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 15))) for _ in range(r.randint(0, 6))]
        docs.append((i, r.choice([" ", "\n", " \t"]).join(parts)))
    long = " ".join(f"v{r.randint(0, 3000)}" for _ in range(30_000))
    docs += [(200, long), (201, "x " + long), (7, docs[3][1]), docs[5], docs[5], (None, docs[9][1]), (None, docs[9][1] + " more"), (None, None), (300, ""), (301, " \n"), (302, "a " * 500)]
    return docs


@pytest.mark.parametrize("least", [5, 12, 50])
def test_repeats(spark, monkeypatch, least):
    monkeypatch.setattr(op12_substrings, "SHARD_WORDS", 2000)
    monkeypatch.setattr(op12_substrings, "PART_WORDS", 3000)
    docs = repeated_texts(least)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, rid string").repartition(5)
    got = sorted(map(tuple, op12_substrings.digests(df, least).collect()), key=str)
    assert got == brute_repeats(docs, least) and sum(g[2] for g in got) > 100
    texts = op12_substrings.without_repeats(df, least)
    assert texts.columns == ["doc_id", "text", "rid"]
    kept = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in texts.collect())
    assert kept == Counter((g[0], g[3]) for g in got)


def test_repeats_of_nothing(spark):
    assert op12_substrings.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    r = random.Random(2)
    docs = [[r.choice(b"abc") for _ in range(r.randint(0, 40))] for _ in range(30)]
    a = op12_substrings.SuffixAutomaton()
    for i, w in enumerate(docs):
        a.add(w, i)
    assert len(a.next) <= 2 * sum(map(len, docs)) + 1
    for i, w in enumerate(docs):
        held = {tuple(x[k : k + 4]) for x in docs[:i] for k in range(len(x) - 3)}
        gone = [any(tuple(w[k : k + 4]) in held for k in range(max(0, j - 3), j + 1) if k + 4 <= len(w)) for j in range(len(w))]
        spans = a.spans(w, i, 4)
        assert [any(s <= j < e for s, e in spans) for j in range(len(w))] == gone


def brute_words(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(op13_spelling.UPPER, op13_spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = {w: {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1 :]] if len(x) == len(w) and x[:i] + x[i + 1 :] == w[:i] + w[i + 1 :]} - {w} for w in words}
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
        near[w] |= holes.get(w, set())
    form = {}
    for w, some in near.items():
        b = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = b if b is not None and words[b] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("cell", [2048, 40])
def test_spelling(spark, monkeypatch, cell):
    monkeypatch.setattr(op13_spelling, "CELL", cell)
    monkeypatch.setattr(op13_spelling, "LEAF", 4)
    if cell < 2048:
        monkeypatch.setattr(op13_spelling, "SLICE_VALUES", 2000)
        monkeypatch.setattr(op13_spelling, "QUERY_PART", 50)
    r = random.Random(3)
    stems = ["".join(r.choice("abdeÉé÷") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["A" * 3000, "a" * 3001]
    some = [s[:k] + r.choice(["", "a", "ab", "É"]) + s[k + 1 :] for s in stems for k in [r.randrange(len(s)) for _ in range(6)]]
    docs = [(i, r.choice([" ", "9", "Ω", "\n"]).join(r.choice(some if r.random() < 0.7 else stems) for _ in range(r.randint(0, 60)))) for i in range(80)]
    docs += [(None, docs[0][1]), (None, None), (500, ""), docs[4], docs[4]]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string").repartition(3)
    got = op13_spelling.spelling(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(docs))
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] != w[0] for w in want) > 20


def test_spelling_of_nothing(spark):
    assert op13_spelling.spelling(spark.createDataFrame([], "doc_id long, text string")).count() == 0
