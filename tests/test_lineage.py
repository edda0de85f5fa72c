import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import audits, clean, enrich, graph, linear, mapping, vectors
from pairwright.operators.checks import CheckFailed


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_messages_grow_from_split_to_split(spark):
    links = spark.createDataFrame([(1, 0, "message"), (2, 0, "supervise"), (3, 0, "val"), (4, 0, "test")], "pair_id long, label_index long, role string")
    seen = graph.messages(links)
    assert values(seen, "split", "pair_id") == [("test", 1), ("test", 2), ("test", 3), ("train", 1), ("val", 1), ("val", 2)]
    assert {r["n_bad"] for r in graph.message_checks(seen, links).collect()} == {0}
    broken = seen.where("NOT (split = 'val' AND pair_id = 2)").union(spark.createDataFrame([("test", 4, 0), ("test", 9, 0)], seen.schema))
    assert values(graph.message_checks(broken, links), "check", "n_bad") == [("alien", 1), ("leaked", 1), ("not_nested", 0)]
    assert values(graph.message_checks(seen.where("NOT (split = 'test' AND pair_id = 2)"), links), "check", "n_bad") == [("alien", 0), ("leaked", 0), ("not_nested", 1)]


def test_negatives_must_be_there(spark):
    full = spark.createDataFrame([(p, n) for p in range(4) for n in range(2)], "pair_id long, label_index long")
    labels = spark.range(2).withColumnRenamed("id", "label_index")
    with pytest.raises(CheckFailed):
        graph.required_negatives(full, labels)
    some = full.where("label_index = 0 OR pair_id = 1")
    drawn = values(graph.required_negatives(some, spark.range(50).withColumnRenamed("id", "label_index")), "pair_id", "label_index")
    assert drawn and len(drawn) <= some.count() and not set(drawn) & set(values(some, "pair_id", "label_index"))


def test_lineage_of_what_is_not_there(spark):
    edges = spark.createDataFrame([(0, 0), (1, 0), (0, 5), (None, None)], "pair_id long, label_index long")
    pairs = spark.createDataFrame([(0, "a", "b")], "pair_id long, e1 string, e2 string")
    labels = spark.createDataFrame([(0, "n")], "label_index long, label_name string")
    got = graph.edge_lineage(edges, pairs, labels, spark.createDataFrame([("a",), ("b",)], "entity string"))
    assert sorted((str(r.pair_id), r.has_pair, r.has_label, r.has_vectors, r.name_hash is None) for r in got.collect()) == [
        ("0", True, False, True, True), ("0", True, True, True, False), ("1", False, True, False, False), ("None", False, False, False, True)]


def test_stored_vectors(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, entity string")
    source = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", [5.0, 6.0])], "entity string, v array<float>")
    good = index.join(source, "entity").select("id", "v")
    assert {r["n_bad"] for r in vectors.stored_checks(good, index, source).collect()} == {0}
    bad = spark.createDataFrame([(0, [1.0, 2.5]), (2, [5.0, 6.0]), (2, [5.0, 6.0]), (7, [0.0, 0.0])], "id long, v array<float>")
    found = dict(values(vectors.stored_checks(bad, index, source), "check", "n_bad"))
    assert found == {"missing": 1, "alien": 1, "repeated": 1, "different": 1, "gaps": 5, "length": 0, "not_finite": 0, "zero": 1}
    assert dict(values(vectors.stored_checks(good.limit(0), index, source), "check", "n_bad"))["missing"] == 3
    odd = spark.createDataFrame([([0.0, 1.0],), ([0.0, None],), ([2.0],), ([],)], "v array<double>")
    assert values(vectors.domain_check(odd, [0, 1]), "n_bad") == [(2,)]


def test_states_and_classes(spark):
    rows = spark.createDataFrame([("x", True, "p", True), ("S1", None, "p", True), ("S2", True, "  ", True), ("S3", True, "p", None), ("S4", True, "p", True), (None, True, "p", True)], "k string, f boolean, p string, v boolean")
    got = [r[0] for r in rows.select(mapping.status_ladder(F.col("k"), "^S[0-9]+$", F.col("f"), F.col("p"), F.col("v"))).collect()]
    assert got == ["invalid_format", "not_found", "missing_payload", "invalid", "mapped", "invalid_format"]
    meta = spark.createDataFrame([("a", "found", 0, False), ("b", "found", 2, False), ("c", "found", 1, True), ("d", "missing", 0, False), ("e", None, 0, False)], "id string, status string, n_aliases long, has_description boolean")
    assert values(enrich.richness(meta), "class", "n", "pct") == [("name", 1, 20.0), ("name+aliases", 1, 20.0), ("name+aliases+description", 1, 20.0), ("name+description", 0, 0.0)]
    assert [r.id for r in enrich.exceptions(meta).orderBy("id").collect()] == ["d", "e"]
    assert {r.n for r in enrich.richness(meta.limit(0)).collect()} == {0}


def test_examples(spark):
    ids = spark.createDataFrame([(x,) for x in ["C1", "C1", "C2", "bad", "bad", None, " ", "", *[f"z{i}" for i in range(5)]]], "id string")
    assert values(audits.id_examples(ids, "id", "^C[0-9]$", 3), "kind", "value", "n") == [
        ("duplicate", "C1", 2), ("duplicate", "bad", 2), ("malformed", "bad", 2), ("malformed", "z0", 1), ("malformed", "z1", 1), ("missing", "", 2), ("missing", " ", 1)]
    names = spark.createDataFrame([("1", n) for n in "dcba"] + [("2", "a"), ("2", " "), ("3", "x")], "label_id string, label_name string")
    assert values(clean.conflict_examples(names), "check", "key", "values") == [("id_to_names", "1", ["a", "b", "c"]), ("name_to_ids", "a", ["1", "2"])]


def test_layers(spark):
    r = np.random.default_rng(3)
    x, layers = r.normal(size=(20, 5)), [r.normal(size=(7, 6)), r.normal(size=(4, 8)), r.normal(size=(3, 5))]
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "pair_id long, v array<double>").repartition(3)
    want = x
    for k, w in enumerate(layers):
        want = np.hstack([want, np.ones((20, 1))]) @ w.T
        want = np.where(want < 0, 0.1 * want, want) if k < 2 else 1 / (1 + np.exp(-want))
    got = values(linear.forward(v, layers, 0.1), "pair_id", "label_index", "score")
    assert np.allclose([g[2] for g in got], want.ravel(), atol=1e-12)
    cells = lambda m, a, b: spark.createDataFrame([(i, j, float(y)) for i, row in enumerate(m) for j, y in enumerate(row)], f"{a} long, {b} long, " + ("w double" if b == "out" else "value double"))
    sums, own, a, b = r.normal(size=(6, 3)), r.normal(size=(6, 3)), r.normal(size=(3, 2)), r.normal(size=(3, 2))
    got = values(graph.neighbour_layer(cells(sums, "node", "dim"), cells(own, "node", "dim"), cells(a, "dim", "out"), cells(b, "dim", "out")), "node", "out", "value")
    assert np.allclose([g[2] for g in got], (sums @ a + own @ b).ravel())
