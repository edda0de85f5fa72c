"""Hand-worked cases of reports that complete others."""
from pyspark.sql import functions as F

from pairwright.operators import audits, edges, encoder, enrich, reports
from pairwright.sources import associations


def test_average_precision_of_the_first_edges_of_each_scorer(spark):
    rows = [("a", 1, 1, 1, 0.9), ("a", 2, 1, 0, 0.8), ("a", 3, 1, 1, 0.7), ("a", 4, 1, 1, 0.1), ("b", 2, 2, 1, 0.5), ("b", 1, 2, 0, 0.5), ("c", 1, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "scorer string, pair_id long, label_index int, y int, score double")
    assert {r.scorer: r.ap_at_k for r in edges.flat_ap(df, 3).collect()} == {"a": round((1 + 2 / 3) / 2, 6), "b": 0.5, "c": 0.0}  # of equal scores the smaller key is first
    got = {r.scorer: r for r in edges.edge_metrics(df, 3).collect()}
    assert got["c"].auroc is None and got["c"].auprc is None and got["c"].ap_at_k == 0.0 and got["b"].auroc == 0.5


def test_runs_beyond_the_baseline(spark):
    runs = spark.createDataFrame([("x", 0.8), ("y", 0.7), ("z", None)], "run string, metric double")
    base = spark.createDataFrame([("sum", 0.7)], "scorer string, auroc double")
    assert {r.run: r.exceeds for r in edges.beyond(runs, base).collect()} == {"x": True, "y": False, "z": None}


def test_members_of_duplicate_groups(spark):
    rows = [(1, "x", "p"), (2, "x", "p"), (3, "y", "p"), (4, "y", None), (5, "z", None), (6, "x", "q")]
    got = enrich.duplicate_members(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"]).collect()
    assert sorted((r.attribute, r.place, r.value, r.n, r.member) for r in got) == [("a", 0, "x", 3, 1), ("a", 0, "x", 3, 2), ("a", 0, "x", 3, 6), ("a", 1, "y", 2, 3), ("a", 1, "y", 2, 4), ("b", 0, "p", 3, 1), ("b", 0, "p", 3, 2), ("b", 0, "p", 3, 3)]


def test_whole_profile(spark):
    df = spark.createDataFrame([(2, None, 1.5), (1, "b", 1.5), (3, "b", None), (4, None, None)], "k int, `a b` string, c double")
    got = {r["column"]: tuple(r)[1:] for r in audits.whole_profile(df, "k").collect()}
    assert got == {"k": ("int", 4, 0, 0.0, 4, "1"), "a b": ("string", 4, 2, 50.0, 1, "b"), "c": ("double", 4, 2, 50.0, 1, "1.5")}
    assert audits.whole_profile(df.limit(0), "k").count() == 0
    one = audits.rows_per_key(df, ["a b", "c"]).first()
    assert (one.n_keys, one.least, one.median, one.mean, one.most) == (4, 1, 1.0, 1.0, 1)


def test_missing_tokens_on_reading(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b,c,d\nNA,n/a,null,NaN\nx, NA,NULL,none\nna,N/A,,<NA>\n")
    got = associations.raw_csv(spark, str(p)).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None), ("x", " NA", None, "none"), ("na", None, None, None)]
    assert associations.raw_csv(spark, str(p), []).first()[0] == "NA"


def test_keys_indexes_and_old_values(spark):
    keys = spark.createDataFrame([("CID000000012",), ("CID12",), ("1CID000000012",), (None,), ("CIDs00000001",)], "k string")
    assert [r[0] for r in keys.select(enrich.key_number(F.col("k"))).collect()] == [12, None, None, None, None]
    texts = spark.createDataFrame([("b", "one two three"), ("a", None), ("c", "one")], "k string, text string")
    got = sorted(encoder.text_index(texts, "k", 2).collect(), key=lambda r: r.place)
    assert [(r.place, r.k, r.n_words, r.truncated) for r in got] == [(0, "a", 1, False), (1, "b", 3, True), (2, "c", 1, False)]
    assert [tuple(r) for r in encoder.over_limit(texts, "k", 2).collect()] == [("b", 3)]
    old, new = spark.createDataFrame([(1, 0.5), (2, 0.25)], "i int, ap double"), spark.createDataFrame([(1, 0.75), (3, 1.0)], "i int, ap double")
    assert sorted(map(tuple, reports.beside_old(old, new, ["i"], "ap").collect())) == [(1, 0.5, 0.75, 0.25), (2, 0.25, None, None), (3, None, 1.0, None)]
    pairs = spark.range(50).select(F.col("id").alias("pair_id"))
    positives = pairs.select("pair_id", F.explode(F.array(F.lit(0), F.when(F.col("pair_id") < 7, 1).otherwise(2))).alias("label_index"))
    assert [tuple(r) for r in reports.labels_of_first(pairs, positives, 10, 2).collect()] == [(0, 10), (1, 7)]
