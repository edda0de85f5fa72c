"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams; a text's is
the mean over its words; a softmax over a linear map of it gives the score. So a
misspelled or compounded word shares n-gram vectors with the words of training.
The model is fitted on a bounded sample of labelled rows; scoring reads every
whole text, and as the map is linear each distinct word costs one number.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Most labelled rows of each class that training reads: those of the smallest hashes of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
BUCKETS, DIMENSION, GRAMS = 1 << 18, 4, (3, 4, 5)
#: The buckets whose shares of the words differ most between the classes, in standard errors, get a vector, at most so many; other n-grams count as zero vectors.
MOST_BUCKETS, LEAST_TEXTS = 2000, 2
#: A bucket's share of a text is shrunk by z^4 / (z^4 + SHRINK^4), z being these standard errors, and its vector decays.
SHRINK, DECAY = 5.0, 1e-5
#: Without a bucket whose classes differ by so many standard errors, which chance hardly gives, nothing is learnt.
CHANCE = 5.0
#: Most characters of a text that training reads; longer texts aren't in the sample.
MOST_CHARS = 50_000
#: Largest share of toxic texts that a text without evidence is taken to have: below the threshold, so that such a text is never rejected.
MOST_PRIOR = 0.25
EPOCHS, RATE, SEED = 150, 0.05, 7
#: Distinct words of a generation; a worker keeps the numbers of two.
CACHE_WORDS = 250_000
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>*#%$&-_=+/\\|~`^"


def words_of(text: str) -> list[str]:
    """White-space words as they stand; `plain` gives the form that n-grams are taken of."""
    return text.split()


def plain(word: str) -> str:
    return word.lower().strip(_EDGES)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one after the other, and how many each word has (at least its own whole)."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    h, found, whose = flat + np.uint64(1), [], []
    prime = np.uint64(1_000_003)
    rolled = h
    for n in range(2, max(GRAMS) + 1):
        if len(h) < n:
            break
        rolled = rolled[:-1] * prime + h[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            found.append(rolled[inside] * np.uint64(2 * n + 1))
            whose.append(owner[: len(owner) - n + 1][inside])
    # the whole word: the sum of its characters by place
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max()) if len(sizes) else 0, 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if len(words):
        found.append(np.add.reduceat(h * powers[place], starts))
        whose.append(np.arange(len(words)))
    grams, owners = np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(whose or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    grams = grams[order]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: its vector times the difference of the classes
    bias: float

    def word_values(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, counts = gram_buckets(words)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(self.weights[grams], starts) / counts


def _bags(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order; and text, word and share of each distinct word of each text."""
    known: dict[str, int] = {}
    docs, words, shares = [], [], []
    for i, t in enumerate(texts):
        ids = np.array([known.setdefault(w, len(known)) for w in map(plain, words_of(t)) if w], np.int32)
        found, first, n = np.unique(ids, return_index=True, return_counts=True)
        order = np.argsort(first)
        docs.append(np.full(len(found), i, np.int32))
        words.append(found[order])
        shares.append(n[order] / max(1, len(ids)))
    listed = sorted(known)
    rank = np.empty(len(listed), np.int32)
    rank[[known[w] for w in listed]] = np.arange(len(listed))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return listed, join(docs, np.int32), rank[join(words, np.int32)], join(shares, np.float64)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Joint training of n-gram vectors and the softmax by Adam over the whole sample.

    With no text, one class or no n-gram that tells the classes apart beyond chance there
    is nothing to learn: every score is then that of the prior, which rejects nothing.
    """
    prior = float((weights * labels).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.0
    if 0 < prior < 1:
        weights = np.where(labels == 1, weights * min(1.0, MOST_PRIOR * (1 - prior) / (prior * (1 - MOST_PRIOR))), weights)
    prior = min(prior, MOST_PRIOR)
    bias0 = float(np.log((prior + 1e-4) / (1 - prior + 1e-4)))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), bias0)
    listed, doc, word, share = _bags(texts)
    if not listed:
        return Model(np.zeros(BUCKETS), bias0)
    n_texts = len(texts)
    made = [(g.astype(np.int32), c) for g, c in (gram_buckets(listed[k : k + 5000]) for k in range(0, len(listed), 5000))]
    grams, counts = np.concatenate([g for g, _ in made]), np.concatenate([c for _, c in made])
    del made, listed
    gram_word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    # in how many texts of either class the words of a bucket are
    seen = [np.bincount(word[labels[doc] == k], minlength=len(counts)).astype(np.float64) for k in (0, 1)]
    in_class = [np.bincount(grams, s[gram_word], minlength=BUCKETS) for s in seen]
    clean, toxic = (c / max(1.0, s.sum()) for c, s in zip(in_class, seen))
    both = (in_class[0] + in_class[1]) / (seen[0].sum() + seen[1].sum())
    error = np.sqrt(both * (1 / max(1.0, seen[0].sum()) + 1 / max(1.0, seen[1].sum()))) + 1e-12
    z = np.where(in_class[0] + in_class[1] >= LEAST_TEXTS, np.abs(toxic - clean) / error, 0.0)
    if z.max() < CHANCE:
        return Model(np.zeros(BUCKETS), bias0)
    bar = np.partition(z, BUCKETS - MOST_BUCKETS)[BUCKETS - MOST_BUCKETS] if BUCKETS > MOST_BUCKETS else 0.0
    trust = np.where((z > 0) & (z >= bar), z**4 / (z**4 + SHRINK**4), 0.0)
    of = trust[grams] > 0
    grams, gram_word = grams[of], gram_word[of]
    del in_class, seen, clean, toxic, both, error, z, of
    # the mean over words of the mean over n-grams is one sparse row of bucket shares per text
    have = np.bincount(gram_word, minlength=len(counts))
    start = np.cumsum(have) - have
    some = have[word] > 0
    doc, word, share = doc[some], word[some], share[some]
    if not len(doc):
        return Model(np.zeros(BUCKETS), bias0)
    used = np.unique(grams)
    slots = np.searchsorted(used, grams).astype(np.int32)
    cells, values = [], []
    cuts = np.searchsorted(doc, np.arange(0, n_texts + 50, 50))  # 50 texts at a time
    for a, e in zip(cuts.tolist(), cuts[1:].tolist()):
        size, w = have[word[a:e]], word[a:e]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[w], size)
        cell, at = np.unique(np.repeat(doc[a:e].astype(np.int64), size) * len(used) + slots[place], return_inverse=True)
        cells.append(cell)
        values.append(np.bincount(at, np.repeat(share[a:e] / counts[w], size)).astype(np.float32))
    cell, value = np.concatenate(cells), np.concatenate(values)
    del cells, values, grams, slots, gram_word, word, share
    doc, slot = cell // len(used), cell % len(used)
    filled, doc_at = np.unique(doc, return_index=True)
    by_slot = np.argsort(slot, kind="stable")
    slot_at = np.searchsorted(slot[by_slot], np.arange(len(used)))
    scale = np.float32(1 / np.sqrt(np.add.reduceat(value * value, doc_at).mean()))
    value *= trust[used][slot].astype(np.float32)
    doc_of, value_of = doc[by_slot], value[by_slot][:, None]
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 1e-3, (len(used), DIMENSION)).astype(np.float32)
    linear = np.zeros((DIMENSION, 2), np.float32)
    linear[:, 1] = rng.normal(0, 1, DIMENSION)
    bias = np.array([0.0, bias0], np.float32)
    params = [vectors, linear, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    onehot = np.eye(2, dtype=np.float32)[labels]
    weight = (weights / weights.sum()).astype(np.float32)[:, None]
    for epoch in range(1, EPOCHS + 1):
        means = np.zeros((n_texts, DIMENSION), np.float32)
        means[filled] = np.add.reduceat(vectors[slot] * value[:, None], doc_at, axis=0) * scale
        logits = means @ linear + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        wrong = (p - onehot) * weight
        grads = [np.add.reduceat((wrong @ linear.T)[doc_of] * value_of, slot_at, axis=0) * scale + DECAY * vectors, means.T @ wrong, wrong.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-8)
    out = np.zeros(BUCKETS)
    out[used] = vectors.astype(np.float64) @ (linear[:, 1] - linear[:, 0]).astype(np.float64) * float(scale) * trust[used]
    return Model(out, float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    """Rows that training never sees the label of."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled rows that aren't held out. Rows of null doc_id, label or text are left out; of several labels of a doc_id the largest counts, of several texts the smallest."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.length("text") <= MOST_CHARS).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toLocalIterator()
    got = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows), key=lambda r: r[0])
    y = np.array([r[2] for r in got], np.int64)
    each = Counter(y.tolist())
    weight = np.array([sizes[k] / each[k] for k in y.tolist()], np.float64)  # the classes weigh as all labelled rows do
    texts = [r[1] for r in got]
    del got
    return fit(texts, y, weight)


class Scorer:
    """Scores of texts in one worker; keeps the numbers of words it has met in this generation and the one before."""

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}

    def __call__(self, texts: list[str]) -> list[float]:
        parts = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = set().union(*parts).difference(self.known)
        met = new.intersection(self.older)
        self.known.update(zip(met, map(self.older.__getitem__, met)))
        new = list(new.difference(met))
        forms = [plain(w) for w in new]
        distinct = list(set(f for f in forms if f))
        value = dict(zip(distinct, self.model.word_values(distinct).tolist()))
        value[""] = 0.0
        self.known.update(zip(new, map(value.__getitem__, forms)))
        get = self.known.__getitem__
        out = []
        for p in parts:
            z = self.model.bias + (sum(map(get, p)) / len(p) if p else 0.0)
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))).item())
        return out


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null and empty texts get the score of the prior. Repeated rows and equal texts get
    equal scores; a null doc_id counts as not held out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    made: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = made[0] if made else Scorer(shipped.value)
        made[:] = [scorer]
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                scores = scorer([t or "" for t in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model doesn't predict as toxic, columns as they are. A row and its score stay together: no join.

    Null and empty texts get the score of the prior and stay; long texts count whole; an
    empty table gives no rows.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                scores = scorer([t or "" for t in some.column("text").to_pylist()])
                yield some.filter(pa.array([s < 0.3 for s in scores]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
