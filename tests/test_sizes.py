"""Faults that showed on larger tables alone, each on a small table that has what made it."""
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairwright import catalog
from pairwright.functions import shared
from pairwright.operators import clean, compare, graph, metrics, vectors
from pairwright.plans import records
from pairwright.sources import artifacts, associations


def test_planted_changes_take_none_back(spark):
    key = next(k for k in range(2003 * 3001) if k % 2003 == 5 and k % 3001 == 11)  # missing and added again
    there = next(k for k in range(13, 2003 * 4001, 4001) if (k + 10_000_000) % 2003 == 5)  # moved to a key that is missing
    o = spark.createDataFrame([(k,) for k in (key, key + 1, there, there + 10_000_000)], "o_orderkey long").select("o_orderkey", F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(500).cast("long").alias("o_totalprice"))
    prints = lambda d: artifacts.range_fingerprints(d, "o_orderkey", 64)
    got = {tuple(r) for r in artifacts.differing_ranges(prints(o), prints(records.changed_orders(o))).collect()}
    n = 2 if key // 64 == (key + 1) // 64 else 1
    assert {(key // 64, n, n), ((there + 10_000_000) // 64, 1, 1)} <= got


def test_groups_are_numbered_in_order_over_ranges(spark):
    rows = [(a, b, i) for i in range(3) for a in ("y", "x", None, "z") for b in (2, 1, None)]
    df = spark.createDataFrame(rows, "a string, b long, i long").repartition(5)
    got = shared.dense_groups(df, ["a", "b"], "g", "new").collect()
    order = sorted({(a, b) for a, b, _ in rows}, key=lambda k: [(x is not None, x) if x is not None else (False, "" if i == 0 else 0) for i, x in enumerate(k)])
    assert len(got) == len(rows) and {(r.a, r.b): r.g for r in got} == {k: i for i, k in enumerate(order)}
    assert sorted((r.a or "", r.b or 0) for r in got if r.new) == sorted((a or "", b or 0) for a, b in order)


def test_prepared_is_the_same_by_numbers_and_by_texts(spark):
    d = "/root/testdata/sf0.001"
    named = associations.names(spark, d)
    numbers, texts = clean.prepare(associations.coded(spark, d, named)), clean.prepare(associations.associations(spark, d))
    assert numbers.pairs.schema["e1"].dataType.typeName() == "long"
    for n in ("triples", "labels", "pairs", "positives"):
        a, b = getattr(numbers, n), getattr(texts, n)
        a = a if n == "positives" else associations.decoded(a, named)
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_numbers_beyond_their_digits_are_texts(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for t in ("orders", "nation", "customer"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey").cast("long") + 10**9 - 3).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert associations.coded(spark, str(tmp_path), associations.names(spark, str(tmp_path))) is None


def test_cells_are_no_product_of_partitions(spark):
    splits = spark.range(40).select(F.col("id").alias("pair_id"), F.lit("A").alias("e1"), F.concat(F.lit("B"), "id").alias("e2"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    positives, labels = spark.range(40).select(F.col("id").alias("pair_id"), (F.col("id") % 3).alias("label_index")), spark.range(3).select(F.col("id").alias("label_index"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells = graph.structural_cells(splits, positives, labels)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
        assert {(r.pair_id, r.label_index) for r in cells.collect() if r.y} == {(i, i % 3) for i in range(0, 40, 4)} and cells.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_first_cells_of_labels_without_a_sort_of_all(spark, monkeypatch):
    monkeypatch.setattr(metrics, "GATHERED", 50)
    rng = random.Random(4)
    rows = [(i, l, rng.randint(0, 1), rng.choice([None, float("nan"), *[x / 4 for x in range(5)]])) for l in range(3) for i in range(400)]
    cells = spark.createDataFrame(rows, "pair_id long, label_index long, y int, score double").repartition(4)
    first = metrics.first_in_tasks(cells, 7)
    assert first.count() <= 4 * 3 * 7
    key = lambda r: (0 if r[3] != r[3] and r[3] is not None else 2 if r[3] is None else 1, -(r[3] if r[3] is not None and r[3] == r[3] else 0), r[0])
    want = {r[:2] for l in range(3) for r in sorted((r for r in rows if r[1] == l), key=key)[:7]}
    assert want <= {(r.pair_id, r.label_index) for r in first.collect()}
    plan = metrics.label_ap(cells, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_vectors_come_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCKS", 3)
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0]), ("b", None), ("c", [None, 1.0]), (None, [9.0]), ("d", [])], "entity string, v array<float>").repartition(3)
    names = ["a", "b", "c", "d", "none", None]
    pairs = spark.createDataFrame([(i * 6 + j, x, y) for i, x in enumerate(names) for j, y in enumerate(names)], "pair_id long, e1 string, e2 string").repartition(2)
    got = vectors.both_ends(pairs, v)
    a, b = v.select(F.col("entity").alias("e1"), F.col("v").alias("va")), v.select(F.col("entity").alias("e2"), F.col("v").alias("vb"))
    assert got.columns == ["pair_id", "e1", "e2", "va", "vb"]
    want = pairs.join(a, "e1").join(b, "e2").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 25
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row with a vector of one end is shuffled to the other
    assert vectors.both_ends(pairs, v.limit(0)).count() == 0 == vectors.both_ends(pairs.limit(0), v).count()


def test_each_query_makes_the_frames_that_it_needs(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "_MADE", {})
    made = lambda: {k[-1] for k in catalog._MADE}
    n = catalog.n_labels(spark, d)
    assert made() == {"names", "triples", "labels"}  # the number of labels takes no pairs
    p, x = catalog.splitted(spark, d)
    got, want = catalog.cells(spark, d), graph.structural_cells(x, p.positives, p.labels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and p.labels.count() == n
    assert "cells" not in made()  # a row a pair and a row a label are stored, not their product


def test_first_cells_of_pairs_without_a_shuffle_of_all(spark):
    rng = random.Random(6)
    some = lambda: rng.choice([None, float("nan"), *[i / 5 for i in range(6)]])
    rows = [(p, label, some(), some()) for p in range(30) for label in range(40)]
    cells = spark.createDataFrame(rows, "pair_id long, label_index long, a double, b double").repartition(3)
    first = compare.first_of_pairs(cells, 4).collect()
    key = lambda i: lambda r: (2 if r[i] is None else 0 if r[i] != r[i] else 1, 0 if r[i] is None or r[i] != r[i] else -r[i], r[1])
    want = {r[:2] for p in range(30) for i in (2, 3) for r in sorted((r for r in rows if r[0] == p), key=key(i))[:4]}
    assert want <= {(r.pair_id, r.label_index) for r in first} and len(first) <= 3 * 30 * 8 < len(rows)
    assert "MapInArrow" in compare.jaccard(cells, 4)._jdf.queryExecution().optimizedPlan().toString()


def _small_tables(spark, path, orders):
    """The tables that associations come from: an order with two or three suppliers, a nation a customer."""
    write = lambda t, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
    write("nation", [(i, f"N{i}") for i in range(4)], "n_nationkey int, n_name string")
    write("customer", [(i, i) for i in range(4)], "c_custkey long, c_nationkey int")
    write("orders", [(k, c, "1-URGENT") for k, (c, _) in enumerate(orders)], "o_orderkey long, o_custkey long, o_orderpriority string")
    write("lineitem", [(k, s, i) for k, (_, supp) in enumerate(orders) for i, s in enumerate(supp)], "l_orderkey long, l_suppkey long, l_linenumber int")
    write("embeddings", [(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")


def test_top_labels_by_themselves_after_others_and_with_rare_labels(spark, monkeypatch, tmp_path):
    queries = entry.queries()
    for d in ("/root/testdata/sf0.001", str(tmp_path)):
        if d == str(tmp_path):
            _small_tables(spark, d, [(0, [1, 2, 3]), (0, [4, 5, 6]), (0, [4, 7]), (2, [1, 2]), (1, [2, 1]), (1, [5, 5])])
        counts = clean.frequency(clean.triples(associations.associations(spark, d))).select("label_id", "n")
        want = sorted((tuple(r) for r in counts.collect()), key=lambda r: (-r[1], r[0]))[:20]
        for first in ((), ("label_table",)):
            monkeypatch.setattr(catalog, "_MADE", {})
            for name in first:
                queries[name](spark, d).collect()
            assert [tuple(r) for r in queries["top_labels"](spark, d).collect()] == want
    assert want == [("C0000001", 7), ("C0000011", 1), ("C0000021", 1)]  # one label stays, three are counted
