"""Checks that raise, artifacts on disk, mappings, prompts and vector audits on small tables with breaches."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions.shared import running_sums
from pairwright.operators import audits, checks, compare, edge_scores, encoder, enrich, history, mapping, prompts, vectors
from pairwright.sources import artifacts, associations


def counts(df):
    return {r["check"]: r["n_bad"] for r in df.collect()}


def test_enforce_and_required_columns(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "k int, v int")
    b = spark.createDataFrame([(1, 2), (5, 6)], "k int, v int")
    got = checks.same_keys(a, b, ["k", "v"])
    assert counts(got) == {"first_only": 2, "second_only": 1}
    with pytest.raises(checks.CheckFailed, match="first_only: 2, second_only: 1"):
        checks.enforce(got)
    assert checks.enforce(checks.same_keys(a, a, ["k"]), a) is a
    assert checks.require_columns(a, ["v"]) is a
    with pytest.raises(checks.CheckFailed, match=r"missing \['x'\]"):
        checks.require_columns(a, ["v", "x"])


def test_whole_join_loses_and_multiplies_nothing(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    one = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, y double")
    assert checks.whole_join(a, one, ["k"]).count() == 2
    with pytest.raises(checks.CheckFailed, match="lost: 1"):
        checks.whole_join(a, one.where("k <> 2"), ["k"])
    with pytest.raises(checks.CheckFailed, match="multiplied: 1"):
        checks.whole_join(a, one.unionByName(one.where("k = 1")), ["k"])


def test_configurations_and_widths(spark):
    a, b = spark.createDataFrame([(1, "x", None)], "n int, s string, z string"), spark.createDataFrame([(1, "y", None)], "n int, s string, z string")
    assert {r.field: r.same for r in checks.comparable(a, b, ["n", "s", "z"]).collect()} == {"n": True, "s": False, "z": True}
    w = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (7, [1.0, 2.0]), (8, None)], "label_index long, w array<double>")
    assert counts(checks.widths(w, 2, 3)) == {"width": 2, "no_weights": 1, "alien": 2}


def test_aligned_with_null_and_repeated_keys(spark):
    a = spark.createDataFrame([(None, "x"), (None, "y"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    b = spark.createDataFrame([(None, "y"), (None, "x"), (1, "b"), (2, None), (4, "d")], "k int, v string")
    assert counts(audits.aligned(a, b, "k", ["v"])) == {"first_only": 1, "second_only": 1, "different": 1}


def test_fingerprint_tells_rows_apart(spark):
    of = lambda *rows: artifacts.fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
    assert of(("a|b", "c")) != of(("a", "b|c")) and of((None, "x")) != of(("", "x")) and of(("a", "b"), ("c", "d")) == of(("c", "d"), ("a", "b"))


def test_replace_keeps_the_old_table_if_the_job_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.replace(spark.range(3).toDF("i"), path)
    artifacts.replace(spark.range(5).toDF("i"), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        artifacts.replace(spark.range(5).select(F.raise_error(F.lit("no")).alias("i")), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if ".old-" in p.name) == []


def test_cache_asks_again_after_a_failure(spark, tmp_path):
    path, keys = str(tmp_path / "cache"), spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    rows = lambda *r: spark.createDataFrame(r, "key string, status string, at long")
    artifacts.add_responses(spark, path, rows(("a", "ok", 1), ("b", "failed", 1)))
    cache = artifacts.add_responses(spark, path, rows(("a", "failed", 2), ("b", "ok", 2)))
    assert sorted(r.key for r in artifacts.to_fetch(keys, cache, "key").collect()) == ["a", "c"]
    assert artifacts.to_fetch(keys, artifacts.stored(spark, str(tmp_path / "none")), "key").count() == 3


def test_text_sources_and_scored_tables(spark, tmp_path):
    artifacts.write_csv(spark.createDataFrame([(1, 0.5, "x")], "i int, r double, s string"), str(tmp_path / "c"), 3)
    got = associations.typed_csv(spark, str(tmp_path / "c"))
    assert dict(got.dtypes) == {"i": "int", "r": "double", "s": "string"} and got.first().r == 0.5
    (tmp_path / "ids.txt").write_text("12\n\n  x \n")
    assert [r.id for r in associations.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["12", "x"]
    import gzip

    with gzip.open(tmp_path / "raw.csv.gz", "wt") as f:
        f.write("a,b,c,d\n1,2,L,name\n")
    assert [tuple(r) for r in associations.raw_csv(spark, str(tmp_path / "raw.csv.gz")).collect()] == [("1", "2", "L", "name")]
    with pytest.raises(Exception):
        associations.raw_csv(spark, str(tmp_path / "absent.csv")).count()
    cells = spark.createDataFrame([(1, 2, 0, 0.25)], "pair_id int, label_index int, y int, score double")
    for model in ("a", "b", "a"):
        associations.write_scored(cells, str(tmp_path / "scored"), model)
    assert [tuple(r) for r in associations.read_scored(spark, str(tmp_path / "scored"), "a").collect()] == [(1, 2, 0, 0.25)]


def test_audit_as_json(spark, tmp_path):
    artifacts.write_audit(spark.createDataFrame([("a", None)], "metric string, value double"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"metric":"a","value":null}'
    doc = compare.document({"one": spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), "two": spark.range(0)}).first().document
    assert json.loads(doc) == {"one": [{"k": 1, "v": None}, {"k": 2, "v": "x"}], "two": []}


def test_mapping_on_a_small_table(spark):
    m = spark.createDataFrame([("A", "mapped", "p", 1), ("B", "invalid", " ", 2), ("B", "mapped", "p", 2), ("C", None, None, 3)], "entity string, status string, payload string, key int")
    p = spark.createDataFrame([(0, "A", "B"), (0, "A", "D"), (1, "A", "C")], "pair_id int, e1 string, e2 string")
    assert counts(mapping.mapping_checks(m, p)) == {"not_mapped": 2, "repeated": 1, "no_payload": 2, "unknown_ends": 1, "repeated_pairs": 1}
    assert tuple(mapping.eligibility(p, m).first()) == (3, 1, 2, 33.33)
    assert tuple(mapping.coverage(m).first()) == (3, 2, 66.67, 1, 2)
    assert mapping.coverage(m.limit(0)).first().mapped_pct is None


def test_prompts(spark):
    pairs = spark.createDataFrame([(0, "A", "B"), (1, "C", "D")], "pair_id long, e1 string, e2 string")
    labels = spark.createDataFrame([(0, "L", "loud")], "label_index long, label_id string, label_name string")
    sample = spark.createDataFrame([(0, 1, 0, 1), (1, 0, 0, 0)], "sample_idx long, pair_id long, label_index long, y int")
    t = prompts.transcripts(sample, pairs, labels, [("q", 1)], "be brief", swapped=True)
    m = {r.sample_idx: [(x.role, x.content) for x in r.messages] for r in t.collect()}
    assert [r for r, _ in m[0]] == ["system", "user", "assistant", "user"] and m[0][3][1].startswith("A: D\nB: C\nLabel: loud")
    got = prompts.in_sample_order(prompts.ask(t, lambda x: [0.25 if "A: D" in c[-1][1] else 0.5 for c in x]).drop("sample_idx"), sample).collect()
    assert [(r.sample_idx, r.p_yes, r.predicted) for r in got] == [(0, 0.25, 0), (1, 0.5, 1)]


def test_vector_audits_against_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 5)).round(3)
    m[7] = m[3]
    m[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k int, v array<double>")
    got = encoder.diagnostics(df.select("v")).first()
    norms = np.linalg.norm(m, axis=1)
    u = m / np.clip(norms, 1e-12, None)[:, None]
    c = (u @ u.T)[~np.eye(60, dtype=bool)]
    assert np.allclose(tuple(got)[:4], (norms.mean(), norms.std(), c.mean(), c.std()), atol=2e-6) and tuple(got)[4:] == (1, 1)
    tokens = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("x", 2, 1), ("x", 3, 0), ("y", 4, 0), ("z", 99, 1)], "key string, token int, mask int")
    pooled = {(r.key, r.dim): r.value for r in encoder.mean_pooled(tokens, df.select(F.col("k").alias("token"), "v")).collect()}
    want = (m[1] + 2 * m[2]) / 3
    assert sorted(pooled) == [("x", i) for i in range(5)] and np.allclose([pooled["x", i] for i in range(5)], want)
    assert np.allclose(spark.createDataFrame([(m[0].tolist(), m[1].tolist())], "a array<double>, b array<double>").select(edge_scores.products("a", "b")).first()[0], m[0] * m[1])
    assert vectors.order_free(lambda a, b: F.zip_with(a, b, lambda x, y: x - y), F.col("a"), F.col("b")) is not None


def test_edge_scores_by_class(spark):
    edges = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 1), (3, 9, 1)], "pair_id int, label_index int, y int")
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "pair_id int, v array<double>")
    got = edge_scores.score_edges(edges, p, spark.createDataFrame([(0, [3.0, 0.0])], "label_index int, v array<double>"))
    assert {r.pair_id: (r.dot, r.norm_product, r.cosine) for r in got.collect()} == {0: (3.0, 3.0, 1.0), 1: (0.0, 6.0, 0.0), 2: (0.0, 0.0, None)}
    assert {r.y: (r.mean_cosine, r.n) for r in edge_scores.cosines_by_class(got).collect()} == {0: (0.0, 1), 1: (1.0, 1)}
    assert {r.scorer: r.auroc for r in edge_scores.aucs(got).collect()} == {"dot": 0.75, "norm_product": 0.0, "cosine": 1.0}


def test_small_columns(spark):
    row = spark.createDataFrame([(["b ", "", "a", "b"], '{"InformationList":{"Information":[{"CID":1,"Synonym":["x","y"]}]}}', "broken", None)], "t array<string>, s string, u string, w string")
    got = row.select(enrich.semantic_types(F.col("t")), *[enrich.synonyms(F.col(c)) for c in "suw"]).first()
    assert list(got) == [["a", "b"], ["x", "y"], [], []]
    z = history.z_scores(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 1.0)], "metric string, value double"), spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 0.0)], "metric string, mean double, std double"))
    assert {r.metric: (r.z, r.v) for r in z.withColumn("v", history.verdict(F.col("z"))).collect()} == {"a": (2.0, "close"), "b": (None, "undefined"), "c": (None, "undefined")}


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.1), v / 7 - 20, rng.randint(0, 9)) for v in rng.sample(range(2000), 500)]
    got = {(r.g, r.s): r.t for r in running_sums(spark.createDataFrame(rows, "g int, s double, x int"), "g", "s", {"t": "x"}, 8).collect()}
    assert got == {(g, s): sum(x for h, t, x in rows if h == g and t >= s) for g, s, _ in rows}
    assert running_sums(spark.createDataFrame([], "g int, s double, x int"), "g", "s", {"t": "x"}).count() == 0
