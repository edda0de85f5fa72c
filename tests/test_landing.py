"""Landed responses, caseless names, versioned tables and ranged fingerprints."""
import pytest
from pyspark.sql import functions as F

from pairwright.functions import shared
from pairwright.operators import audits, clean, enrich, landing, mapping
from pairwright.sources import artifacts, snapshots


def test_states_and_claims_of_any_json_type(spark):
    bodies = [
        (1, 200, '{"claims": {"P1": ["b", "a", "b"], "P2": "alone"}}'), (2, 200, '{"claims": {"P1": [{"id": "Q5"}, {"x": 1}, 7, 1.5, null, true, [1]]}}'), (3, 200, '{"claims": {"P1": null}}'),
        (4, 200, '{"claims": {"P1": {"id": "Q9"}}}'), (5, 200, '{"claims"'), (6, 200, None), (7, 404, "not json"), (8, 500, '{"claims": {"P1": "x"}}'), (9, None, None), (10, 200, "[1]"), (11, 200, "{}"),
    ]
    df = landing.landed(spark.createDataFrame(bodies, "key long, http_status int, body string"))
    p = lambda n: landing.claim_texts(F.col("parsed"), n).alias(n)
    listed = landing.results(F.col("state"), F.col("parsed"), "$.claims.P1")
    got = {r.key: r for r in df.select("key", "state", p("P1"), p("P2"), F.size(listed).alias("n"), listed.isNull().alias("unknown")).collect()}
    assert [got[k].state for k in range(1, 12)] == ["ok"] * 4 + ["malformed"] * 2 + ["empty", "failed", "failed", "ok", "ok"]
    assert got[1].P1 == ["a", "b"] and got[1].P2 == ["alone"] and got[2].P1 == ["1.5", "7", "Q5", "true"]
    assert got[4].P1 == ["Q9"] and all(got[k].P1 == [] for k in (3, 5, 6, 7, 8, 9, 10, 11))
    assert got[7].n == 0 and not got[7].unknown and all(got[k].unknown for k in (5, 6, 8, 9)) and (got[2].n, got[3].n, got[4].n) == (7, 0, 1)
    assert {r.state: (r.n, r.again) for r in landing.states(df).collect()} == {"ok": (6, 0), "malformed": (2, 2), "empty": (1, 0), "failed": (2, 2)}


def test_compounds_alone_and_in_lists(spark):
    wrap = lambda x: '{"PropertyTable": {"Properties": %s}}' % x
    rows = [(1, 200, wrap('[{"CID": 5, "SMILES": "C", "Title": "a"}, {"CID": "6", "SMILES": null}]')), (2, 200, wrap('{"CID": 7, "SMILES": "N", "Title": 3}')), (3, 200, wrap("[]")), (4, 404, None), (5, 200, "{")]
    got = sorted(map(tuple, landing.compounds(landing.landed(spark.createDataFrame(rows, "key long, http_status int, body string"))).collect()), key=str)
    assert got == sorted([(1, "ok", 5, "C", "a"), (1, "ok", 6, None, None), (2, "ok", 7, "N", "3"), (3, "ok", None, None, None), (4, "empty", None, None, None), (5, "malformed", None, None, None)], key=str)


def test_caseless_names(spark):
    names = ["Straße", "STRASSE", " strasse ", "ΣΑΣ", "σας", "É", "é", "e", "", "Zoë", "zoe"]
    df = spark.createDataFrame([(names, "ÉÉ".lower()[:1].upper())], "n array<string>, d string")
    assert df.select(enrich.first_spellings(F.col("n"))).first()[0] == ["e", "É", "Straße", "zoe", "Zoë", "ΣΑΣ"]
    assert "É" not in df.select(enrich.first_spellings(F.col("n"), F.col("d"))).first()[0]
    pairs = spark.createDataFrame([(1, "Straße", "STRASSE "), (2, "ΣΑΣ", "σας"), (3, "é", "e"), (4, None, "")], "i int, a string, b string")
    assert [r.i for r in mapping.case_differences(pairs, "a", "b").collect()] == [3]
    ids = spark.createDataFrame([("x", "Straße"), ("x", "STRASSE"), ("y", "σας"), ("z", "ΣΑΣ")], "label_id string, label_name string")
    count = lambda **how: {r.check: r.n_bad for r in clean.name_conflicts(ids, **how).collect()}
    assert count() == {"id_to_names": 1, "name_to_ids": 0} and count(caseless=True) == {"id_to_names": 0, "name_to_ids": 1}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "_stage", "_commit"])
@pytest.mark.parametrize("late", [False, True])
def test_a_kill_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step, late):
    path = str(tmp_path / "t")
    t = snapshots.Snapshots(spark, path)
    assert t.read() is None and t.versions() == []
    t.replace(spark.range(3).toDF("i"))
    done = getattr(snapshots.Snapshots, step)

    def killed(self, *a):
        if late:
            done(self, *a)
        raise Killed

    monkeypatch.setattr(snapshots.Snapshots, step, killed)
    for write in (t.replace, t.append):
        with pytest.raises(Killed):
            write(spark.range(5).toDF("i"))
    monkeypatch.setattr(snapshots.Snapshots, step, done)
    n = snapshots.Snapshots(spark, path).read().count()
    assert n == (5 + 5 if (step, late) == ("_commit", True) else 3)  # the rename is the commit
    t.append(spark.range(4).toDF("i"))
    assert t.read().count() == n + 4
    t.expire(keep=1, older_s=0)
    assert t.read().count() == n + 4 and len(t.versions()) == 1
    assert not any(x.startswith("staged") for x in t._names("manifests")) and len(t._names("data")) == len(t._manifest(t.versions()[0])["data"])


def test_readers_are_pinned_and_writers_conflict(spark, tmp_path, monkeypatch):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"))
    t.replace(spark.range(3).toDF("i"))
    old = t.read()
    t.replace(spark.range(8).toDF("i"))
    assert old.count() == 3 and t.read().count() == 8 and t.read(0).count() == 3 and t.read(9) is None
    known = t.versions()
    monkeypatch.setattr(t, "versions", lambda: known)  # it doesn't see another's commit
    snapshots.Snapshots(spark, t.path).append(spark.range(2).toDF("i"))
    with pytest.raises(snapshots.Conflict):
        t.replace(spark.range(1).toDF("i"))
    seen = iter([known])
    monkeypatch.setattr(t, "versions", lambda: next(seen, None) or snapshots.Snapshots(spark, t.path).versions())
    t.append(spark.range(4).toDF("i"))  # goes on from the other's version
    assert t.read().count() == 8 + 2 + 4
    with pytest.raises(ValueError):
        t.append(spark.range(4).toDF("j"))
    t.replace(spark.range(0).toDF("i"))
    assert t.read().columns == ["i"] and t.read().count() == 0


def test_differing_ranges(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), F.lit(None).cast("string").alias("s")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 1L AS x, 'n' AS s"))
    b = a.withColumn("x", F.when(F.col("k") == 777, 99).otherwise(F.col("x"))).where("k IS NULL OR k <> 1300").unionByName(a.where("k = 2600")).withColumn("s", F.when(F.col("k") == 4001, "-").otherwise(F.col("s")))
    prints = lambda d: artifacts.range_fingerprints(d, "k", 10, 8, 4)
    got = {tuple(r) for r in artifacts.differing_ranges(prints(a), prints(b.repartition(7)), 8, 4).collect()}
    assert got == {(77, 10, 10), (130, 10, 9), (260, 10, 11), (400, 10, 10)}
    assert artifacts.differing_ranges(prints(a), prints(a.repartition(5, "x")), 8, 4).count() == 0
    other = b.withColumn("x", F.when(F.col("k").isNull(), 2).otherwise(F.col("x")))
    assert None in {r["range"] for r in artifacts.differing_ranges(prints(a), prints(other), 8, 4).collect()}
    whole = artifacts.fingerprint(a).first()
    top = prints(a).where("level = 3").agg(F.sum("n_rows"), *[F.sum(h) % (1 << 32) for h in artifacts.LANES]).first()
    assert tuple(whole) == tuple(top)


def test_link_contract_of_broken_links(spark):
    positives = spark.range(1000).select(F.col("id").alias("pair_id"), F.lit(1).alias("label_index"))
    role = F.when(F.col("pair_id") < 300, "val").when(F.col("pair_id") < 310, "test").otherwise("message")
    links = positives.withColumn("role", role).where("pair_id <> 999")
    links = links.unionByName(links.where("pair_id < 3").withColumn("role", F.lit("message"))).unionByName(links.where("pair_id = 5").withColumn("pair_id", F.lit(5000).cast("long")))
    assert {r.check: r.n_bad for r in audits.link_contract(links, positives).collect()} == {"val_share": 1, "test_share": 1, "several_roles": 3, "alien": 1, "no_role": 1}


def test_frames_are_cleared(spark):
    df = shared.written(spark.range(4))
    assert df.count() == 4 and shared.clear_frames(spark) >= 1 and shared.clear_frames(spark) == 0
