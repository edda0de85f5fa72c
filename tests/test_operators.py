import random

from pairwright.functions.shared import dense_id, prefix_sums
from pairwright.operators import clean, compare, metrics, split

SIX = [("A", "B", "L1", "one"), ("B", "A", "L1", "one"), ("A", "C", "L1", "one"), ("B", "C", "L2", "two"), ("A", "A", "L1", "one"), ("A", "B", "L2", "two")]


def assoc(spark, rows):
    return spark.createDataFrame(rows, "entity_1 string, entity_2 string, label_id string, label_name string")


def test_six_rows(spark):
    df = assoc(spark, SIX)
    assert clean.self_pairs(df).first().n_rows == 1
    assert clean.triples(df).count() == 4
    p = clean.prepare(df, min_pairs=2)
    assert [(r.label_id, r.n) for r in p.labels.orderBy("label_index").collect()] == [("L1", 2), ("L2", 2)]
    got = sorted((r.pair_id, r.label_index) for r in p.positives.collect())
    assert got == [(0, 0), (0, 1), (1, 0), (2, 1)]  # AB:{1,2} AC:{1} BC:{2}
    assert sum(r.n_bad for r in clean.pair_checks(p.pairs).collect()) == 0
    assert sum(r.n_bad for r in clean.label_checks(p).collect()) == 0


def test_rare_label_leaves(spark):
    p = clean.prepare(assoc(spark, SIX + [("A", "B", "L3", "three")]), min_pairs=2)
    assert p.labels.where("label_id = 'L3'").count() == 0


def test_missing_and_stripped(spark):
    df = assoc(spark, [("A", " ", None, "x "), ("B", "C", "L", " y")])
    assert {r["column"]: r.missing for r in clean.missing_counts(df, clean.KEYS).collect()} == {"entity_1": 0, "entity_2": 1, "label_id": 1, "label_name": 0}
    assert {r["column"]: r.changed for r in clean.strip_counts(df, ["label_name"]).collect()} == {"label_name": 2}


def test_name_conflicts(spark):
    df = assoc(spark, [("A", "B", "L1", "one"), ("A", "C", "L1", "uno"), ("A", "C", "L2", "one"), ("A", "C", "L2", " ")])
    assert {r.check: r.n_bad for r in clean.name_conflicts(df).collect()} == {"id_to_names": 1, "name_to_ids": 1}


def test_split_sizes(spark):
    pairs = spark.range(100).selectExpr("id AS pair_id", "concat('A', id) AS e1", "concat('B', id) AS e2")
    got = {r["split"]: r["count"] for r in split.split_pairs(pairs).groupBy("split").count().collect()}
    assert got == {"train": 80, "val": 10, "test": 10}
    twice = split.split_pairs(pairs).unionByName(split.split_pairs(pairs).limit(1))
    assert {r.check: r.n_bad for r in split.split_checks(pairs, twice).collect()}["several"] == 1


def test_dense_id_and_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = [(r.k, r.i) for r in dense_id(df, ["v", "k"], "i").collect()]
    want = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert dict(got) == want
    run, total = {}, 0
    for k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        run[k] = total
    assert {r.k: r.s for r in prefix_sums(df, ["v", "k"], {"s": "v"}).collect()} == run


def cells(spark, rows):
    return spark.createDataFrame(rows, "pair_id int, label_index int, y int, score double")


def step_ap(rows):
    """Average precision of (y, score), equal scores as one step; None without positives."""
    total, tp, seen, ap = sum(y for y, _ in rows), 0, 0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, t in rows if t == s]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) * tp / seen
    return ap / total if total else None


def random_cells(seed, pairs=40, labels=6):
    """Scores of few values, so that most are tied; the last label has no positive, the one before no negative."""
    rng = random.Random(seed)
    return [(i, j, {labels - 1: 0, labels - 2: 1}.get(j, int(rng.random() < 0.3)), rng.randint(0, 7) / 8) for i in range(pairs) for j in range(labels)]


def test_pair_ap_against_brute_force(spark):
    rows, k, total = [r for r in random_cells(1) if r[0] % 9 or not r[2]], 4, 0.0
    pairs = {r[0] for r in rows}
    for i in pairs:
        mine = sorted((-s, j, y) for p, j, y, s in rows if p == i)
        hits = [sum(y for *_, y in mine[:r]) / r for r in range(1, min(k, len(mine)) + 1) if mine[r - 1][2]]
        total += sum(hits) / min(k, sum(m[2] for m in mine)) if any(m[2] for m in mine) else 0.0
    got = metrics.pair_ap(cells(spark, rows), k).first()
    assert (got.ap_at_k, got.n_pairs) == (round(total / len(pairs), 6), len(pairs))


def test_label_ap_on_ties_against_brute_force(spark):
    for seed in range(3):
        rows = random_cells(seed)
        for k in (1, 5, 13, 100):
            got = {r.label_index: r for r in metrics.label_ap(cells(spark, rows), k).collect()}
            full = none = 0
            for j in range(6):
                top = [(y, s) for s, _, y in sorted(((s, i, y) for i, l, y, s in rows if l == j), key=lambda t: (-t[0], t[1]))[:k]]
                want = step_ap(top)
                assert abs(got[j].ap - (want or 0.0)) < 1e-12 and (got[j].kept, got[j].n_pos) == (len(top), sum(y for y, _ in top))
                full += all(y for y, _ in top)
                none += not any(y for y, _ in top)
            counts = metrics.degenerate(metrics.label_ap(cells(spark, rows), k)).first()
            assert (counts.n_labels, counts.all_positive, counts.all_negative) == (6, full, none)


def test_label_metrics_against_brute_force(spark):
    rows = random_cells(5, pairs=300)
    got = {r.label_index: r for r in metrics.per_label(cells(spark, rows)).collect()}
    for j in range(6):
        mine = [(y, s) for _, l, y, s in rows if l == j]
        pos, neg = [s for y, s in mine if y], [s for y, s in mine if not y]
        auroc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        want = [auroc, step_ap(mine)]
        for g, w in zip((got[j].auroc, got[j].auprc), want):
            assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-6)


def test_micro_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, j, int(rng.random() < 0.3), round(rng.random(), 1)) for i in range(30) for j in range(5)]
    tp = seen = 0
    ap = 0.0
    for s in sorted({r[3] for r in rows}, reverse=True):
        p, n = sum(r[2] for r in rows if r[3] == s), sum(r[3] == s for r in rows)
        tp, seen = tp + p, seen + n
        ap += p * tp / seen
    assert metrics.micro_auprc(cells(spark, rows)).first()[0] == round(ap / tp, 6)


def test_scorer_against_itself(spark):
    df = spark.createDataFrame([(i, j, (i + j) % 2, i * j / 10, i * j / 10) for i in range(4) for j in range(6)], "pair_id int, label_index int, y int, a double, b double")
    assert compare.jaccard(df, 3).first()["mean"] == 1.0
    assert compare.agreement(df).first()["agree_pct"] == 100.0
    assert compare.pearson(df).first()["pearson"] == 1.0


def test_best_threshold_of_near_ties(spark):
    rows = [(0, j, y, s) for j, (y, s) in enumerate([(1, 0.9), (1, 0.62), (0, 0.61), (0, 0.2)])]
    assert metrics.best_threshold(cells(spark, rows)).first().t == 62
    assert metrics.best_threshold(cells(spark, [(0, j, 1, 0.95) for j in range(3)])).first().t == 5  # all alike: the smallest


def test_white_space_counts_as_missing(spark):
    df = assoc(spark, [("\t", "\u00a0", "\n ", "x"), (None, "", "L", "y")])
    assert {r["column"]: r.missing for r in clean.missing_counts(df, clean.KEYS).collect()} == {"entity_1": 2, "entity_2": 2, "label_id": 1, "label_name": 0}
