import math

import pytest
from pyspark.sql import functions as F

from pairwright.operators import audits, losses, reports


def test_losses_against_plain_python(spark):
    rows = [(x, y) for x in (-60.0, -1.5, 0.0, 2.0, 60.0) for y in (0, 1)]
    x, y = F.col("x"), F.col("y")
    df = spark.createDataFrame(rows, "x double, y int")
    got = df.select("x", "y", losses.cross_entropy(x, y).alias("ce"), losses.focal(x, y, 1.5, 0.3, 0.2).alias("f"), losses.focal(x, y, 0, -1).alias("off")).collect()
    for r in got:
        p = 1 / (1 + math.exp(-r.x))
        t = r.y * 0.8 + 0.1
        ce = lambda t: max(r.x, 0) - r.x * t + math.log1p(math.exp(-abs(r.x)))
        assert r.ce == pytest.approx(ce(r.y)) and r.off == pytest.approx(ce(r.y))
        assert r.f == pytest.approx(ce(t) * (1 - (p * t + (1 - p) * (1 - t))) ** 1.5 * (0.3 * t + 0.7 * (1 - t)))
    with pytest.raises(ValueError):
        losses.focal(x, y, smoothing=1.0)


def test_decay(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (25,)], "s int")
    assert [r.w for r in df.select(losses.decay(F.col("s"), 2.0, 10, 0.5).alias("w")).collect()] == [2.0, 2.0, 1.0, 0.5]
    assert df.select(losses.decay(F.col("s"), 1.0, 10, 0.5, False).alias("w")).collect()[3].w == pytest.approx(0.5**2.5)
    with pytest.raises(Exception, match="negative"):
        df.select(losses.decay(F.col("s") - 1, 1.0, 10, 0.5).alias("w")).collect()


def test_shares_of_large_logits(spark):
    df = spark.createDataFrame([([800.0, 799.0], [800.0]), ([0.0], [0.0]), ([], [1.0])], "a array<double>, b array<double>")
    got = [r.p for r in df.select(losses.yes_share(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] == pytest.approx((1 + math.exp(-1)) / (2 + math.exp(-1))) and got[1] == 0.5 and got[2] is None


def test_profile_and_ids(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.0), ("a", None), ("", 2.0)], "`n.m` string, v double")
    got = {r["column"]: (r.n_rows, r.n_null, r.null_pct, r.n_distinct) for r in audits.profile(df).collect()}
    assert got == {"n.m": (4, 1, 25.0, 2), "v": (4, 1, 25.0, 2)}
    assert audits.profile(df.limit(0)).count() == 0
    ids = spark.createDataFrame([("C01",), ("C07",), ("x",), (" ",), (None,), ("C01",)], "i string")
    assert tuple(audits.id_profile(ids, "i", "^C([0-9]{2})$").first()) == (6, 2, 3, 1, 4, 1, 7)


def test_aligned(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "y"), (None, "z")], "k int, v string")
    assert {r.check: r.n_bad for r in audits.aligned(a, b, "k", ["v"]).collect()} == {"first_only": 1, "second_only": 1, "different": 1}


def test_link_contract_finds_breaches(spark):
    positives = spark.createDataFrame([(i, 0) for i in range(20)], "pair_id int, label_index int")
    links = spark.createDataFrame([(i, 0, "val" if i < 2 else "test" if i < 12 else "message") for i in range(19)] + [(3, 0, "message"), (99, 0, "message")], "pair_id int, label_index int, role string")
    assert {r.check: r.n_bad for r in audits.link_contract(links, positives).collect()} == {"val_share": 0, "test_share": 1, "several_roles": 1, "alien": 1, "no_role": 1}


def test_common_names(spark):
    rows = [(["DB123", "Tylenol", "Advil", "50-78-2"],), (["a" * 41, "12345"],), ([None, "Ab c", "xyzw"],), (None,), ([],)]
    got = [r.n for r in spark.createDataFrame(rows, "s array<string>").select(audits.common_name(F.col("s")).alias("n")).collect()]
    assert got == ["Advil", None, "Ab c", None, None]


def test_reports_of_undefined_metrics(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0.9, 0.2), (0, 1, 0, 0.1, 0.4), (1, 0, 1, 0.8, 0.6), (1, 1, 0, 0.7, 0.4)], "pair_id long, label_index long, y int, a double, b double")
    got = {r.metric: r for r in reports.metric_comparison(cells).collect()}
    assert got["macro_auroc"].a is None and got["macro_auroc"].winner == "tie"  # each label has one class
    assert got["micro_auprc"].a == 1.0 and got["micro_f1"].winner == "a" and got["pair_ap"].a == 1.0
    r = reports.robustness(cells).first()
    assert (r.n, r.flipped, r.changed) == (4, 0.5, 1.0) and r.mean_change == pytest.approx((0.7 + 0.3 + 0.2 + 0.3) / 4)
