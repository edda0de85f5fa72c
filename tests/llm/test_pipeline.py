"""The pipeline against a plain version of its stages, row by row."""
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pairwright.llm import near_copies, op3_secrets, op6_exact, op7_toxicity, op9_simhash

P = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [" ".join(some(80)) for _ in range(60)]
    texts += [" ".join(some(30) + [rng.choice(["wubbaz", "wubbazes", "xwubbaz"]) for _ in range(3)]) for _ in range(30)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " ", None, "", " ", None]
    long = some(1500)
    texts += [" ".join(long[:k] + ["other"] + long[k + 1 :]) for k in range(5)]  # near copies
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(24)]
    return texts + [" ".join(some(40)) + f' token = "{h}" ' + " ".join(some(5)) for h in hexes]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, model):
    """doc_id and masked text of what stays; rows of no doc_id stand behind all others."""
    by_id = lambda r: (r[0] is None, r[0] or 0)
    score = op7_toxicity.Scorer(model)
    rows = [(d, t) for d, t in rows if score([t or ""])[0] < 0.3]
    firsts = {}
    for d, t in sorted(rows, key=by_id):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (d, t))
    rows = sorted(firsts.values(), key=by_id)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b) > 0] for a in sets]
    while True:  # the smallest row that each one reaches
        new = [min(root[j] for j in n) for n in near]
        if new == root:
            break
        root = new
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    values = {}
    for _, t in rows:
        for _, _, kind, v in op3_secrets.base_spans(t or ""):
            values.setdefault(kind, set()).add(v)
    automata = op3_secrets.infer({k: list(v) for k, v in values.items()})
    out = []
    for d, t in rows:
        base = op3_secrets.base_spans(t or "")
        other = [{"start": a, "end": e, "value": v} for a, e, v in op3_secrets.candidates(t or "", base)]
        out.append((d, op3_secrets.masked(t or "", [s[:3] for s in base] + op3_secrets.added(other, automata))))
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = list(enumerate(corpus()))
    rng = random.Random(12)
    some = lambda: " ".join("".join(rng.choice("bcdfgaei") for _ in range(rng.randint(3, 8))) for _ in range(90))
    twins, alone = [some() for _ in range(3)], [some() for _ in range(3)]
    rows += [(500, t) for t in twins] + [(None, t) for t in alone]  # one doc_id of several texts; none
    rows += [(500, twins[0]), (None, alone[0]), (None, twins[1] + " x"), (501, alone[1].replace(alone[1].split()[40], "other"))]  # equal rows; near copies of one with a doc_id, and one that stays for a null one
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    labels = spark.createDataFrame([(d, 1, int(60 <= d < 90)) for d in range(90)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = plain(rows, op7_toxicity.train(docs, labels))
    assert set(got) == {d for d, _ in want} and sorted(str(d) for d, _ in want if d is None or d >= 500) == ["500"] * 3 + ["501", "None", "None"]
    for d in (500, None):  # rows that share a doc_id can't be told apart in the result: all their ids are there
        n = [len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids) + 1 for x, t in want if x == d]
        assert sum(r.start == 0 for r in got[d]) == len(n) and sum(r.length for r in got[d]) == sum(n) and sorted({r.doc_tokens for r in got[d]}) == sorted(set(n))
    assert not set(range(60, 90)) & set(got) and set(range(60)) <= set(got)  # toxic ones go, clean ones stay
    assert not any("token = " in t for _, t in want)
    encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, t in [w for w in want if w[0] not in (500, None)]:
        ids, at = np.array(encoder.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(got[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_near_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(n))
    alone, copied, single, twice = [some(60) for _ in range(5)], some(60), some(60), [some(60) for _ in range(3)]
    rows = [(None, t) for t in alone]  # unrelated
    rows += [(None, copied), (4, copied.upper()), (None, copied.title())]  # a component of three
    rows += [(None, single), (None, single)]  # equal rows
    rows += [(7, twice[0]), (7, twice[1]), (3, twice[1].upper()), (7, twice[2])]  # an id of three texts, one of them in a component of a smaller id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in op9_simhash.stage(spark, docs, "").collect()]
    want = [(None, t) for t in [*alone, single]] + [(4, copied.upper()), (3, twice[1].upper()), (7, twice[0]), (7, twice[2])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_dedup_by_shingle_similarity(spark):
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    texts = []
    for length, changes in [(60, 1), (100, 1), (300, 3), (500, 10), (100, 3), (100, 5), (3000, 30), (3000, 200)] * 12:
        w = words(length)
        for _ in range(2):  # a copy of the text, and a copy of that copy
            texts.append(w)
            w = list(w)
            for k in rng.sample(range(length // 10), changes) if changes < length // 10 else rng.sample(range(length), changes):
                w[k * 9 % length] = "other" + str(rng.random())
    sets, root = [shingles(w) for w in texts], list(range(len(texts)))
    for i in range(1, len(texts), 2):
        a, b = sets[i - 1], sets[i]
        if len(a & b) >= 0.8 * len(a | b):
            root[i] = i - 1
    assert 40 <= sum(r != i for i, r in enumerate(root)) <= len(texts) // 2 - 12
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in op9_simhash.stage(spark, docs, "").collect()}
    assert got == {i for i, r in enumerate(root) if r == i}


def test_near_dedup_by_simhash_blocks(spark):
    # a pair of similarity 0.806 that shares no band: its fingerprints differ in 4 bits, so blocks find it
    rng = random.Random(138759)
    a = [str(rng.random())[2:8] for _ in range(60)]
    b = a[:25] + ["z"] + a[26:59] + ["y"]
    sets = [np.unique(near_copies.shingle_hashes(" ".join(w), 5)) for w in (a, b)]
    assert len(np.intersect1d(*sets)) >= 0.8 * len(np.union1d(*sets)) and not set(near_copies.band_keys(sets[0])) & set(near_copies.band_keys(sets[1]))
    other = [" ".join(str(rng.random())[2:8] for _ in range(60)) for _ in range(20)]
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, None), (3, " ")] + [(10 + i, t) for i, t in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in op9_simhash.stage(spark, docs, "").collect())
    assert got == [0, 2, *range(10, 30)]


def test_groups_of_linked_fingerprints(spark):
    rng = random.Random(16)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [f ^ 0b1111 << 20 for f in base[:10]] + [f ^ 0b11111 << 20 for f in base[10:20]] + base[20:25]  # 4 bits, 5 bits, equal
    fps += [base[0] ^ 0b1111 << 20 ^ 0b1111 << 40]  # over another one only
    nodes = [(i.to_bytes(16, "big"), f - (f >> 63 << 64)) for i, f in enumerate(fps)] + [(b"none" * 4, None)]
    groups = {}
    for r in op9_simhash.linked_fingerprints(spark.createDataFrame(nodes, "node binary, fp long").repartition(3)).collect():
        groups.setdefault(r.key, set()).add(int.from_bytes(bytes(r.node), "big"))
    want = [{i, 30 + i} | ({55} if i == 0 else set()) for i in range(10)] + [{i} for i in range(10, 20)] + [{30 + i} for i in range(10, 20)] + [{i, 30 + i} for i in range(20, 25)] + [{i} for i in range(25, 30)]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_stages_keep_columns_and_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(15)
    some = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(60))
    rows = [(None, some()) for _ in range(4)] + [(7, some()) for _ in range(3)] + [(1, some()), (2, None)]
    names = ["digest", "_id", "_kept", "row", "ROW_", "_row", "node", "n", "root"]
    docs = spark.createDataFrame([(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(rows)], f"doc_id long, text string, {', '.join(c + ' string' for c in names)}").repartition(3)
    want = sorted(map(str, docs.collect()))
    for stage in (op6_exact.stage, op9_simhash.stage, op3_secrets.stage):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == want
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
