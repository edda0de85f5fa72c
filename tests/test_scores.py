import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright import catalog
from pairwright.functions.shared import shared_dir
from pairwright.operators import bootstrap, edges, enrich, history, linear, ranks, vectors
from pairwright.plans import scores
from pairwright.sources import artifacts


def test_patience_depends_on_the_path(spark):
    rows = [("a", i, m) for i, m in enumerate([0.1, 0.14, 0.18, 0.17, None, 0.9])] + [("b", 0, 0.5)]
    got = {r["run"]: r for r in history.patience(spark.createDataFrame(rows, "run string, epoch long, metric double"), 2, 0.05).collect()}
    assert (got["a"].best_epoch, got["a"].best, got["a"].stop_epoch) == (2, 0.18, 4)
    assert (got["b"].best_epoch, got["b"].stop_epoch) == (0, None)


def test_spearman_and_constant(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, float(rng.randint(0, 5)), float(rng.randint(0, 5))) for i in range(200)]
    mean = lambda v: [sum(x < y for x in v) + (v.count(y) + 1) / 2 for y in v]
    want = np.corrcoef(mean([r[3] for r in rows]), mean([r[4] for r in rows]))[0, 1]
    schema = "pair_id int, label_index int, y int, a double, b double"
    assert ranks.spearman(spark.createDataFrame(rows, schema)).first().spearman == pytest.approx(want, abs=1e-6)
    assert ranks.spearman(spark.createDataFrame([(i, 0, 0, 1.0, float(i)) for i in range(4)], schema)).first().spearman is None


def test_bootstrap_draws_as_many_as_there_are(spark):
    pairs = spark.range(37).selectExpr("id * 3 AS pair_id")
    w = bootstrap.draw_weights(pairs, 5)
    assert {r["rep"]: r["n"] for r in w.groupBy("rep").agg(F.sum("w").alias("n")).collect()} == {i: 37 for i in range(5)}
    same = spark.createDataFrame([(i, j, (i + j) % 2, i * j / 20, i * j / 20) for i in range(5) for j in range(4)], "pair_id long, label_index long, y int, a double, b double")
    assert all((r["mean"], r["a_ahead"], r["b_ahead"], r["p"]) == (0, 0, 0, 1) for r in bootstrap.summary(bootstrap.paired(same, 4)).collect())


def test_flat_metrics_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(s, int(rng.random() < 0.4), float(rng.randint(0, 9))) for s in ("one", "two") for _ in range(150)] + [("none", 0, 1.0)]
    got = {r.scorer: r for r in edges.flat_metrics(spark.createDataFrame(rows, "scorer string, y int, score double")).collect()}
    for s in ("one", "two"):
        pos, neg = ([v for t, y, v in rows if t == s and y == k] for k in (1, 0))
        assert got[s].auroc == round(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg), 6)
    assert got["none"].auroc is None and got["none"].auprc is None


def test_hub_keeps_exactly_k(spark):
    rows = [("hub", f"n{i}") for i in range(500)] + [("leaf", "x")]
    e = spark.createDataFrame(rows, "src string, dst string")
    whole = edges.first_neighbours(e, 7, slices=1)
    assert whole.where("src = 'hub'").count() == 7
    assert sorted(whole.collect()) == sorted(edges.first_neighbours(e, 7).collect())


def test_linear_scorer_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = np.stack([x[:, 0] > 0, x[:, 1] + x[:, 2] > 0.3], 1).astype(int)
    df = spark.createDataFrame([(i, [float(a) for a in r], [int(j) for j in np.flatnonzero(t)]) for i, (r, t) in enumerate(zip(x, y))], "pair_id long, v array<float>, labels array<bigint>")
    end = linear.fitted(df, 2, 3, ridge=1e-2)
    got = end.weights
    h = x.astype(np.float32).astype(float)
    h = np.hstack([h / np.linalg.norm(h, axis=1, keepdims=True), np.ones((60, 1))])
    w = np.zeros((2, 4))
    for _ in range(20_000):
        w -= 1.5 * ((1 / (1 + np.exp(-h @ w.T)) - y).T @ h / 60 + 1e-2 * w)
    assert np.abs(got - w).max() < 1e-6 and end.gradient.max() <= 1e-9 and end.passes.max() < 15
    scores = {(r.pair_id, r.label_index): r.score for r in linear.score(df, got).collect()}
    assert len(scores) == 120 and scores[(5, 1)] == pytest.approx(1 / (1 + np.exp(-h[5] @ w[1])))
    assert not linear.fit(df.limit(0), 2, 3).any()


def test_linear_scorer_in_blocks_of_labels(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, r.tolist(), [j for j in range(5) if r[0] > j / 4 - 0.5] if i % 9 else []) for i, r in enumerate(x)], "pair_id long, v array<double>, labels array<bigint>").repartition(3)
    whole = linear.fitted(df, 6, 2)  # the last label has no positives
    monkeypatch.setattr(linear, "BLOCK_VALUES", 20)
    blocks = linear.fitted(df, 6, 2)
    assert np.abs(whole.weights - blocks.weights).max() < 1e-6 and whole.gradient.max() <= 1e-9 and whole.loss[5] < 0.2


def test_training_sums_curvatures_where_steps_are_slow_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    hits = rng.random((4000, 3)) < 1 / (1 + np.exp(3 - 0.3 * x[:, :3]))
    df = spark.createDataFrame([(i, r.tolist(), np.flatnonzero(h).tolist()) for i, (r, h) in enumerate(zip(x, hits))], "pair_id long, v array<float>, labels array<bigint>")
    curved, sums = [], linear._sums
    monkeypatch.setattr(linear, "_sums", lambda *a: (curved.append(len(a[-1])), sums(*a))[1])
    end = linear.fitted(df, 3, 5)
    assert sum(curved) <= 3 and 4 < len(curved) < 12 and end.gradient.max() <= 1e-9  # after the one Gram matrix at most one curvature a label
    h = x.astype(np.float32).astype(float)
    h = np.hstack([h / np.linalg.norm(h, axis=1, keepdims=True), np.ones((4000, 1))])
    slope = (1 / (1 + np.exp(-h @ end.weights.T)) - hits).T @ h / 4000 + 1e-3 * end.weights
    assert np.abs(slope).max() < 1e-8


def test_examples_and_their_truth(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.0])], "entity string, v array<float>")
    pairs = spark.createDataFrame([(0, "a", "b", "train"), (1, "a", "a", "test"), (2, "a", "none", "test")], "pair_id long, e1 string, e2 string, split string")
    positives = spark.createDataFrame([(0, 2), (0, 0), (2, 1)], "pair_id long, label_index long")
    rows = linear.examples(pairs, v, positives)
    assert {r.pair_id: (r.split, r.labels, r.v) for r in rows.collect()} == {0: ("train", [0, 2], [1.5, 2.0]), 1: ("test", [], [2.0, 4.0])}
    w = np.arange(9.0).reshape(3, 3)
    got, plan = linear.judged(rows, w), linear.judged(rows, w)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.pair_id, r.label_index) for r in got.collect() if r.y} == {(0, 0), (0, 2)} and got.count() == 6 and plan.count("Join") == 1  # labels to pairs, nothing to cells
    scores = {(r.pair_id, r.label_index): r.score for r in linear.score(rows, w).collect()}
    assert {(r.pair_id, r.label_index): r.score for r in got.collect()} == scores


def test_names_and_lists(spark):
    df = spark.createDataFrame([(["  Ab", "aB ", "", "Pref", "aa"], "pref", '[1, "x"]', "umls-2024AB"), (None, None, None, "x")], "n array<string>, p string, j string, r string")
    got = df.select(enrich.first_spellings(F.col("n"), F.col("p")).alias("n"), enrich.as_list(F.col("j")).alias("j"), enrich.release(F.col("r")).alias("r")).collect()
    assert got[0] == (["aa", "Ab"], ["1", "x"], "2024AB") and got[1] == ([], None, "current")


def test_bodies_that_are_malformed_or_bare(spark):
    bodies = [(0, "nonsense"), (1, json.dumps({"entities": {"Q1": {"labels": {"fr": {"value": "x"}}}, "Q2": {"missing": ""}}}))]
    got = {r.id: r for r in enrich.entities(spark.createDataFrame(bodies, "batch long, body string")).collect()}
    assert set(got) == {"Q1", "Q2"} and got["Q1"].label is None and got["Q1"].aliases == [] and got["Q2"].missing


def test_artifacts(spark):
    path = f"{shared_dir(spark)}/artifact"
    assert artifacts.stored(spark, path) is None
    one, two = (spark.createDataFrame([(k, 1.5)], "k long, v double") for k in (1, 2))
    assert artifacts.reuse(one, path, "k").first().k == 1
    assert artifacts.reuse(two, path, "k").first().k == 1
    assert artifacts.reuse(two, path, "k", overwrite=True).first().k == 2
    artifacts.write_csv(one, f"{path}.csv")
    assert spark.read.option("header", True).csv(f"{path}.csv").first().v == "1.50000000"
    shuffled = spark.range(10).repartition(3)
    assert artifacts.fingerprint(shuffled).first() == artifacts.fingerprint(spark.range(10)).first()
    cache = spark.createDataFrame([(1, "ok"), (2, "failed")], "k long, status string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k long")
    assert sorted(r.k for r in artifacts.to_fetch(keys, cache, "k").collect()) == [2, 3]
    assert artifacts.to_fetch(keys, None, "k").count() == 3


@pytest.mark.parametrize("chunk", [262_144, 3])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_packed_examples_are_the_examples(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(linear, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i % 9, rng.normal(size=3).tolist()) for i in range(10)], f"entity long, v array<{kind}>")  # one entity has two
    pairs = spark.createDataFrame([(p, p % 10, p % 7, ("train", "test", "val")[p % 3]) for p in range(60)], "pair_id int, e1 long, e2 long, split string")
    positives = spark.createDataFrame([(p, j) for p in range(0, 60, 2) for j in range(p % 4)], "pair_id long, label_index long")
    rows, chunks = linear.examples(pairs, v, positives), linear.packed(pairs, v, positives)
    weights = rng.normal(size=(4, 4))
    for split in ("train", "val", "test", "none"):
        some, of = rows.where(F.col("split") == split), linear.of_split(chunks, split)
        want, got = (sorted(map(tuple, linear.judged(x, weights).collect())) for x in (some, of))
        assert len(want) == len(got) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12 for a, b in zip(want, got)) and bool(got) == (split != "none")
    assert np.abs(linear.fit(rows.where("split = 'train'"), 3, 3) - linear.fit(linear.of_split(chunks, "train"), 3, 3)).max() < 1e-6
    assert linear.packed(pairs.limit(0), v, positives).count() == 0


def test_stored_examples_have_no_vector_a_pair(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    v = spark.createDataFrame([(i, [float(i)] * 8) for i in range(6)], "entity long, v array<float>")
    pairs = spark.range(300).selectExpr("id AS pair_id", "id % 6 AS e1", "id DIV 6 % 6 AS e2", "'train' AS split")
    assert linear.packed(pairs, v, pairs.selectExpr("pair_id", "0L AS label_index")).selectExpr("sum(length(v))").first()[0] <= 4 * 6 * 8 * 4 < 300 * 8 * 4
    d = "/root/testdata/sf0.001"
    rows, n, dims = scores.linear_examples(spark, d)
    assert "first" in rows.columns
    p, x = catalog.splitted(spark, d)
    want = linear.examples(x, catalog.entity_vectors(spark, d), p.positives)
    ids = lambda df: {(r.pair_id, r.label_index, r.y) for r in linear.judged(df, np.zeros((n, dims + 1))).collect()}
    assert ids(linear.of_split(rows, "test")) == ids(want.where("split = 'test'"))
