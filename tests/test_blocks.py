"""Selection by counting, segmented sums, sums of vectors, Gram matrices and the bootstrap kernel against plain numpy."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import blocks, md5, selection, shared
from pairwright.operators import bootstrap, metrics, reports, split


@pytest.mark.parametrize("buckets", [1 << 16, 4])
def test_keys_at_ranks(spark, monkeypatch, buckets):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    r = random.Random(3)
    rows = [(r.choice([5, 5, 5, 70_000, 2**32 - 1, r.randrange(2**32)]), i, i % 3) for i in range(500)]  # many equal hashes
    df, by = spark.createDataFrame(rows, "h long, i long, j long").repartition(3), ["h", "i"]
    ranks = [0, 1, 137, 138, 250, 499, 500, 900]
    for rank, key in zip(ranks, selection.keys_at(df, by, lambda n: ranks)):
        got = {(x.h, x.i) for x in df.where(selection.before(by, key)).collect()}
        assert got == {x[:2] for x in sorted(rows)[:rank]}
    assert selection.keys_at(df.limit(0), by, lambda n: [0, 5]) == [None, None]
    with pytest.raises(ValueError):
        selection.keys_at(df, ["h"], lambda n: [2, 3])


def test_no_sort_and_no_written_frame(spark, monkeypatch):
    pairs = spark.range(3000).select(F.col("id").alias("pair_id"), F.lit("a").alias("e1"), F.lit("b").alias("e2"))
    for done in (split.split_pairs(pairs), split.sample(pairs, "pair_id", 50, 5)):
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan
    assert split.sample(pairs, "pair_id", 50, 5).count() == 50 and split.sample(pairs, "pair_id", 5000, 5).count() == 3000
    assert {r["split"]: r["count"] for r in split.split_pairs(pairs).groupBy("split").count().collect()} == {"train": 2400, "val": 300, "test": 300}


def test_running_sums_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [(0 if r.random() < 0.9 else r.randrange(1, 5), round(0.5 + r.random() / 1e6, 12), r.randrange(4)) for _ in range(4000)]  # scores close together
    df = spark.createDataFrame(rows, "g int, s double, x long").groupBy("g", "s").agg(F.sum("x").alias("x"))
    placed = shared._placed(df, ["g", F.desc("s")])
    assert placed.where("g = 0").select("_part").distinct().count() >= 3  # the hot group is in several ranges
    got = {(x.g, x.s): x.t for x in shared.running_sums(df, "g", "s", {"t": "x"}).collect()}
    want, steps = {}, {}
    for g, s, x in rows:
        steps[g, s] = steps.get((g, s), 0) + x
    for g in range(5):
        total = 0
        for _, s in sorted(((k[0], k[1]) for k in steps if k[0] == g), reverse=True):
            total += steps[g, s]
            want[g, s] = total
    assert got == want


def test_per_label_of_one_hot_label(spark):
    rng = np.random.default_rng(5)
    y, s = (rng.random(3000) < 0.3).astype(int), np.round(rng.random(3000), 3)
    df = spark.createDataFrame([(i, 0, int(y[i]), float(s[i])) for i in range(3000)] + [(i, 1, 0, 0.5) for i in range(3)], "pair_id long, label_index long, y int, score double")
    got = {r.label_index: r for r in metrics.per_label(df).collect()}
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    ap = sum(((y == 1) & (s == t)).sum() * ((y == 1) & (s >= t)).sum() / (s >= t).sum() for t in np.unique(s)) / len(pos)
    assert abs(got[0].auroc - auc) < 2e-6 and abs(got[0].auprc - ap) < 2e-6
    assert (got[1].auroc, got[1].auprc) == (None, None)


@pytest.mark.parametrize("held", [4_000_000, 40])
def test_vector_sums(spark, monkeypatch, held):
    monkeypatch.setattr(blocks, "HELD", held)
    rng = np.random.default_rng(6)
    keys = [None if rng.random() < 0.05 else "hub" if rng.random() < 0.6 else f"k{rng.integers(0, 40)}" for _ in range(900)]
    v, w = rng.integers(-9, 9, (900, 3)), rng.integers(0, 5, 900)
    rows = [(k, None if i % 50 == 0 else [float(x) for x in v[i]], int(w[i])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, v array<float>, w int").repartition(7)
    for weight in (None, "w"):
        got = blocks.vector_sums(df, "k", weight=weight).collect()
        want = {}
        for k, x, m in rows:
            if k is not None and x is not None:
                want[k] = want.get(k, 0) + np.array(x) * (m if weight else 1)
        assert len(got) == len(want) and all((want[r.k] == np.array(r.v)).all() for r in got)
    assert blocks.vector_sums(df.limit(0), "k").count() == 0


def test_gram_matrix(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 5))
    v[3] = 0
    df = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "v array<double>").repartition(9)
    got = blocks.unit_gram(df).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert len(got) == 1 and np.allclose(got[0].total, u.sum(axis=0)) and np.allclose(np.array(got[0].gram).reshape(5, 5), u.T @ u)
    assert blocks.unit_gram(df.limit(0)).count() == 0


def plain_bootstrap(rows, reps, seed=13, threshold=0.5, k=50):
    pairs, labels = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    n, out = len(pairs), {}
    for rep in range(reps):
        draws = [int(hashlib.md5(f"{rep * n + r}:{seed}".encode()).hexdigest()[:12], 16) % n for r in range(n)]
        w = {p: draws.count(i) for i, p in enumerate(pairs)}
        for s in (3, 4):
            aps = []
            for label in labels:
                own = [(r[s], r[2], w[r[0]]) for r in rows if r[1] == label]
                total = sum(y * m for _, y, m in own)
                if total:
                    aps.append(sum(y * m * sum(b * c for a, b, c in own if a >= x) / sum(c for a, _, c in own if a >= x) for x, y, m in own if y * m) / total)
            hit, said, pos = (sum(f(r) * w[r[0]] for r in rows) for f in (lambda r: r[2] * (r[s] >= threshold), lambda r: r[s] >= threshold, lambda r: r[2]))
            out[rep, "macro_auprc", s] = np.mean(aps) if aps else None
            out[rep, "micro_f1", s] = 2 * hit / (said + pos) if said + pos else 0
    return out


@pytest.mark.parametrize("block, size, values", [(65_536, 64_000_000, 60 * 3), (7, 60 * 2 * 3, 2_000_000), (7, 64_000_000, 20)])
def test_bootstrap_kernel(spark, monkeypatch, block, size, values):
    monkeypatch.setattr(bootstrap, "RUN_VALUES", values)  # some reps at a time, the last ones fewer
    monkeypatch.setattr(bootstrap, "BLOCK", block)  # labels of many runs
    monkeypatch.setattr(bootstrap, "WEIGHT_BYTES", size)  # three reps at a time
    r = random.Random(8)
    rows = [(100 + p, label, int(r.random() < (0.3 if label else 0.01)), round(r.random(), 1), round(r.random(), 2)) for p in range(60) for label in range(3)]
    df = spark.createDataFrame(rows, "pair_id long, label_index long, y int, a double, b double").repartition(3)
    got = {(x.rep, x.metric, s): (x.a, x.b)[s - 3] for x in bootstrap.paired(df, 7).collect() for s in (3, 4)}
    want = {k: v for k, v in plain_bootstrap(rows, 7).items() if v is not None}
    assert {k for k in got if k[1] != "ap_at_k"} == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert bootstrap.paired(df.limit(0), 3).count() == 0


def test_weights_are_summed_between_steps_with_positives(spark, monkeypatch):
    w = np.random.default_rng(4).integers(0, 9, (50, 3)).astype(np.uint8)
    rows, starts = np.arange(49, 9, -1), np.array([0, 1, 5, 30])
    want = [w[rows[a:e]].sum(axis=0).tolist() for a, e in zip(starts, [*starts[1:], len(rows)])]
    for values in (12, 10**6):  # chunks of a row, and all rows at once
        monkeypatch.setattr(bootstrap, "RUN_VALUES", values)
        assert bootstrap.segment_sums(w, rows, starts).tolist() == want
    assert bootstrap.draws(97, range(5, 9), 13).tolist() == [int(hashlib.md5(b"%d:13" % i).hexdigest()[:12], 16) % 97 for i in range(5, 9)]
    assert bootstrap.weight_block(spark, 40, range(2, 5), 13).dtype == np.uint8  # a byte a pair and rep
    drawn = bootstrap.weight_block(spark, 1, range(2), 13)
    assert drawn.tolist() == [[1, 1]]


def test_numbers_are_hashed_by_blocks():
    for a, e in ((0, 3), (9_990, 12_500), (99_998, 131_000), (1_239_999_000, 1_240_004_000)):
        got = np.concatenate(list(md5.first48(range(a, e), b":13")))
        assert len(got) == e - a and all(got[i] == int(hashlib.md5(b"%d:13" % (a + i)).hexdigest()[:12], 16) for i in [*range(0, e - a, 97), e - a - 1])
    w = bootstrap.drawn_of(2_500, 4, 13)
    assert w.tolist() == np.bincount(bootstrap.draws(2_500, range(10_000, 12_500), 13), minlength=2_500).tolist() and w.dtype == np.uint8
    assert bootstrap.drawn_of(1, 3, 13).tolist() == [1]


@pytest.mark.parametrize("slices, values, together, entries", [(7, 2_000_000, True, 500_000), (32_768, 20, False, 500_000), (7, 2_000_000, True, 100)])
def test_bootstrap_by_kinds_of_pairs(spark, monkeypatch, slices, values, together, entries):
    monkeypatch.setattr(bootstrap, "SLICE", slices)
    monkeypatch.setattr(bootstrap, "RUN_VALUES", values)
    monkeypatch.setattr(bootstrap, "ENTRIES", entries)  # at 100 kinds are too many, and labels are sorted each
    r = random.Random(9)
    kinds = [([0, 1, 2, 3, 4][i % 3 :], [(round(r.random(), 1), round(r.random(), 1)) for _ in range(5)]) for i in range(40)]  # some lack labels
    rows = [(100 - p, label, int(r.random() < (0.3 if label else 0)), *scores[label]) for p in range(90) for labels, scores in [r.choice(kinds)] for label in labels]
    df = spark.createDataFrame(rows, "pair_id long, label_index long, y int, a double, b double")
    df = df.coalesce(1) if together else df.repartition(3)
    went, by_kinds = [], bootstrap._by_kinds
    monkeypatch.setattr(bootstrap, "_by_kinds", lambda *a: (went.append(1), by_kinds(*a))[1])
    got = {(x.rep, x.metric, s): (x.a, x.b)[s - 3] for x in bootstrap.paired(df, 7, k=2).collect() for s in (3, 4)}
    want = {k: v for k, v in plain_bootstrap(rows, 7).items() if v is not None}
    assert {k for k in got if k[1] != "ap_at_k"} == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    labels = bootstrap._by_labels(df, 7, 0.5, 2, 13).collect()
    assert len(labels) == 21 and all(abs(got[x.rep, x.metric, s] - (x.a, x.b)[s - 3]) < 1e-9 for x in labels for s in (3, 4))
    assert bool(went) == (entries > 100)


def test_shared_scores_take_no_sort_of_all_cells(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "score_blocks", None)  # a sort of all cells for each scorer, and weights summed by label
    rows = [(p, label, int(p % 5 == label), (p % 3 + label) / 9, label / 5) for p in range(50) for label in range(5)]
    df = spark.createDataFrame(rows, "pair_id long, label_index long, y int, a double, b double")
    assert df.count() == 250 and bootstrap.paired(df, 3).count() == 9


def test_odd_cells_go_by_labels(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "_by_kinds", None)
    rows = [(p, label, int(p % 3 == label), p / 20, label / 5) for p in range(20) for label in range(3)]
    schema = "pair_id long, label_index long, y int, a double, b double"
    whole = bootstrap._by_labels(spark.createDataFrame(rows, schema), 2, 0.5, 50, 13).count()
    for odd in ((0, 0, 1, None, 0.1), (0, 0, 1, float("nan"), 0.1), (0, 2, 1, 0.3, 0.1)):  # the last one a label that is there twice
        df = spark.createDataFrame([*rows[2 if odd[1] == 2 else 1 :], odd], schema)
        assert bootstrap._kinds(df, 0.5, 50) is None
    assert bootstrap.paired(spark.createDataFrame([*rows, (0, 2, 0, 0.3, 0.1)], schema), 2).count() == whole == 6


@pytest.mark.parametrize("steps, sizes", [(2_000_000, 4_000_000), (5, 40)])
def test_metrics_of_distinct_scores(spark, monkeypatch, steps, sizes):
    monkeypatch.setattr(metrics, "STEPS", steps)  # labels that run over several passes
    monkeypatch.setattr(metrics, "SORTED", sizes)
    rng = random.Random(11)
    rows = [(p, label, int(label != 3 and rng.random() < 0.3), round(rng.random(), 2 if label % 2 else 9)) for p in range(80) for label in range(5)]
    shape = "pair_id long, label_index long, y int, score double"
    for cells in (shared.written(spark.createDataFrame(rows, shape).coalesce(2)), shared.written(spark.createDataFrame(rows, shape).repartition(3))):
        rounded = lambda df: sorted(tuple(None if x is None else round(x, 6) for x in r) for r in df.collect())
        assert rounded(metrics.per_label_of_distinct(cells, 0.4)) == rounded(metrics.per_label(cells, 0.4))
        assert rounded(metrics.micro_auprc_of_distinct(cells)) == rounded(metrics.micro_auprc(cells))
        assert rounded(metrics.pair_ap_of_runs(cells, 3)) == rounded(metrics.pair_ap(cells, 3))
    monkeypatch.setattr(metrics, "AGAIN", 0)
    assert rounded(metrics.pair_ap_of_runs(cells, 3)) == rounded(metrics.pair_ap(cells, 3))


def test_distinct_scores_are_not_shuffled(spark, monkeypatch):
    cells = shared.written(spark.range(400).selectExpr("id DIV 4 AS pair_id", "id % 4 AS label_index", "CAST(id % 7 = 0 AS INT) AS y", "sin(id) AS score").coalesce(1))
    want = sorted(map(tuple, reports.aggregates(cells, 0.3).collect()))
    for name in ("running_sums", "prefix_sums", "pair_ap"):  # each sorts all cells
        monkeypatch.setattr(metrics, name, None)
    assert sorted(map(tuple, reports.aggregates(cells, 0.3, distinct=True).collect())) == want
