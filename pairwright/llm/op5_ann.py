"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample and are found through an in-memory graph of
their neighbours. A vector near the border of several clusters is posted to each.
A query reads the lists whose centroid is not much farther than the nearest. Equal
vectors are one entry with its smallest ids, so that copies don't swell a list, and
lists are dealt out in slices of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, table, written

#: Most vectors that centroids are fitted on, and most centroids: bounds what is broadcast.
SAMPLE, MOST_LISTS = 40_000, 8192
#: Vectors to a list aimed at; entries of a slice of a list.
LIST_SIZE, SLICE = 256, 4096
#: A vector is posted to lists within this ratio of its nearest centroid's distance, at most so many.
POST_RATIO, POST_MOST = 1.10, 4
#: A query reads lists within this ratio, at least so many, and at most one of READ_SHARE.
READ_RATIO, READ_LEAST, READ_SHARE = 1.5, 64, 4
#: Column that marks queries.
ASKED = "_asked"
#: Neighbours of a centroid in the graph, and how many candidates a walk keeps.
DEGREE, BREADTH = 24, 96


class CentroidGraph:
    """Unit centroids and, for each, its nearest others; a best-first walk finds those near a vector."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        self.neighbours = np.zeros((n, min(DEGREE, n - 1)), np.int32)
        for k in range(0, n, 1024):
            near = centroids[k : k + 1024] @ centroids.T
            near[np.arange(len(near)), np.arange(k, k + len(near))] = -2
            d = self.neighbours.shape[1]
            if d:
                self.neighbours[k : k + 1024] = np.argpartition(-near, d - 1, axis=1)[:, :d]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to k centroids near a unit vector, nearest first, and their distances."""
        breadth = max(k, BREADTH)
        start = self.centroids[self.entries] @ v
        seen = set(self.entries.tolist())
        heap = [(-s, i) for s, i in zip(start.tolist(), self.entries.tolist())]
        heap.sort()
        best = [(s, i) for s, i in ((-a, i) for a, i in heap)]  # min-heap of what is kept
        best.sort()
        while len(best) > breadth:
            heappop(best)
        while heap:
            s, i = heappop(heap)
            if len(best) >= breadth and -s < best[0][0]:
                break
            new = [j for j in self.neighbours[i].tolist() if j not in seen]
            seen.update(new)
            if new:
                for s, j in zip((self.centroids[new] @ v).tolist(), new):
                    if len(best) < breadth or s > best[0][0]:
                        heappush(best, (s, j))
                        heappush(heap, (-s, j))
                        if len(best) > breadth:
                            heappop(best)
        best.sort(reverse=True)
        ids = np.array([i for _, i in best[:k]], np.int64)
        return ids, np.sqrt(np.maximum(0, 2 - 2 * np.array([s for s, _ in best[:k]])))


    def dealt(self, vectors: np.ndarray, ratio: float, least: int, most: int) -> tuple[list[int], list[int]]:
        """Row numbers and lists: of each unit vector the lists whose centroids are within the ratio of its nearest one's distance, `least` to `most` of them."""
        rows, to = [], []
        for i, v in enumerate(vectors):
            ids, far = self.search(v, most)
            take = max(least, int((far <= far[0] * ratio + 1e-9).sum()))
            to += ids[:take].tolist()
            rows += [i] * min(take, len(ids))
        return rows, to


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means on unit vectors in which a cluster's fill lowers its pull, so that lists come out alike in size."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    penalty = np.zeros(lists)
    for _ in range(rounds):
        own = np.empty(len(sample), np.int64)
        for k in range(0, len(sample), 4096):
            own[k : k + 4096] = (sample[k : k + 4096] @ c.T - penalty).argmax(axis=1)
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = size == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(norm == 0, 1, norm)
        penalty += 0.02 * (size / size.mean() - 1)
        penalty -= penalty.min()
    return c


def clean(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id, embedding of the rows that take part: finite, not zero, no nulls, and of the commonest length (or the one given)."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), *[c for c in vectors.columns if c == ASKED]).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(ok, F.lit(False)))
    if dimension is None:
        first = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = first["d"] if first else 0
    return v.where(F.size("embedding") == dimension)


def unit(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)  # neither squares nor sums overflow
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def cosines(these: np.ndarray, those: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines in double precision; where a product or norm over- or underflows, of the vectors scaled by their largest components."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = these @ those.T / (np.linalg.norm(these, axis=1)[:, None] * norms)
    bad = ~np.isfinite(out).all(axis=1) | (np.abs(these).max(axis=1) < 1e-100)
    if bad.any() or not np.isfinite(norms).all() or (norms < 1e-100).any():
        return unit(these) @ unit(those).T
    return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query, k: int = 5, list_size: int = LIST_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `is_query` selects, ties to the smaller vec_id.

    Rows that can't have a cosine take no part, nor do those of another length than the
    commonest. Copies of a vector are candidates of their own; of rows with equal vec_id
    and vector one counts. With fewer candidates than k, a query returns all it finds. An
    empty table gives no rows; other columns are left out, whatever their names.

    Equal vectors are one entry and are searched for once, with one neighbour more than
    asked for, so that each of their rows can leave itself out.
    """
    spark = vectors.sparkSession
    # two hashes of different seeds stand for a vector: 16 bytes instead of its components
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    base = written(clean(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias(ASKED))).withColumn("key", key), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    # the k + 1 smallest ids of equal vectors are all that a query can need; the limit applies before the shuffle too
    among = Window.partitionBy("key").orderBy("vec_id")
    ids = base.groupBy("key", "vec_id").agg(F.max(ASKED).alias(ASKED), F.min("embedding").alias("embedding"))
    ids = written(ids, "ids")
    kept = ids.withColumn("_r", F.row_number().over(among)).where(F.col("_r") <= k + 1)
    sizes = ids.groupBy("key").agg(F.count_if(ASKED).alias("n_asked"))
    firsts = kept.groupBy("key").agg(F.min("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = written(firsts.join(sizes, "key"), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    # at most SAMPLE vectors, those of the smallest hashes
    some = entries.select("embedding").orderBy("key.a", "key.b").limit(SAMPLE).toArrow()
    sample = unit(matrix(some.column("embedding").combine_chunks()))
    lists = max(1, min(MOST_LISTS, n // list_size, len(sample) // 2))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(sample, lists)))
    most = max(READ_LEAST, -(-lists // READ_SHARE))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, to = graph.value.dealt(unit(matrix(b.column("embedding"))), POST_RATIO, 1, POST_MOST)
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *t.columns], ["list", "key", "embedding", "ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, to = graph.value.dealt(unit(matrix(b.column("embedding"))), READ_RATIO, READ_LEAST, most)
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *t.columns], ["list", "key", "embedding"])

    keys = "struct<a:bigint,b:bigint>"
    postings = written(entries.select("key", "embedding", "ids").mapInArrow(post, f"list int, key {keys}, embedding array<double>, ids array<long>"), "postings")
    wanted = written(entries.where("n_asked > 0").select("key", "embedding").mapInArrow(read, f"list int, key {keys}, embedding array<double>"), "wanted")
    # entries and queries of a list are both dealt out in slices; there is a row a list
    slices = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    parts = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("parts"))
    cut = F.broadcast(slices.join(parts, "list"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.col("key.a"), F.col(c)).cast("int")
    asked = wanted.join(cut, "list").select("list", each("slices").alias("slice"), part("parts").alias("part"), "key", "embedding")
    posted = postings.join(cut, "list").select("list", part("slices").alias("slice"), each("parts").alias("part"), "embedding", "ids")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[dict, int, float]] = []
        if len(left) and len(right):
            those = np.stack(right["embedding"].to_list())
            norms = np.linalg.norm(those, axis=1)
            ids = right["ids"].to_list()
            for a in range(0, len(left), 512):
                these = np.stack(left["embedding"].iloc[a : a + 512].to_list())
                scores = cosines(these, those, norms)
                top = min(k + 1, scores.shape[1])
                low = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top] - 1e-12
                for q, row, least in zip(left["key"].iloc[a : a + 512], scores, low):
                    for j in np.flatnonzero(row >= least).tolist():
                        out += [(q, i, float(row[j])) for i in ids[j]]
        return pd.DataFrame({"key": [o[0] for o in out], "vec_id": [o[1] for o in out], "score": [o[2] for o in out]})

    by = ["list", "slice", "part"]
    found = asked.groupBy(*by).cogroup(posted.groupBy(*by)).applyInPandas(match, f"key {keys}, vec_id long, score double")
    one = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    near = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))
    near = written(near.join(entries.select("key", "n_asked"), "key"), "near")
    queries = ids.where(ASKED).select("key", F.col("vec_id").alias("query_id"))
    own = spread_join(queries, near, "key", "n_asked", queries.count())
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("_i", "x")).select("query_id", (F.col("_i") + 1).alias("rank"), "x.vec_id", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
