"""Hard-negative mining by a multiway hyperplane tree with distance ranges between siblings.

Rows are quantised and lifted by one coordinate to equal length, so that a window of
inner products with an anchor is an annulus of distances around it. A tree of split
points, fitted on a bounded sample, deals every row to the nearest point of each
level; for each point and each sibling subtree the range of distances between them is
taken over all rows. An anchor skips a subtree whose range can't meet its annulus, by
the triangle inequality. What is left goes to the leaf's slices, each of which holds
such a tree of its own with exact leaves.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, table, written

#: Most rows, and most components, of the sample that the upper tree and the first bounds come from.
SAMPLE, SAMPLE_VALUES = 16_384, 2_000_000
#: Rows aimed at in a leaf of the upper tree, most leaves, rows of a slice, anchors that meet a slice at once.
LEAF_ROWS, MOST_LEAVES, SLICE, ANCHORS = 4096, 2048, 8192, 2048
#: Most children of a node, and rows of an exact leaf.
DEGREE, EXACT = 12, 512
POSITIVES, NEGATIVES = 5, 3
NONE = -(1 << 62)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q of the rows that take part: no null among vec_id, label, vector and components, all finite, of the commonest length.

    Components beyond what keeps every inner product in 62 bits leave their row out. Rows
    equal in all three count once.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(ok, F.lit(False)))
    first = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = first["d"] if first else 0
    most = min(2**31 - 1, int(((1 << 62) / max(1, d)) ** 0.5))
    fits = F.forall("embedding", lambda x: F.abs(x * scale) < most)
    rows = rows.where((F.size("embedding") == d) & fits)
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("q")).distinct()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where these hold them, else by 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def lifted(q: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more coordinate, so that the square of each one's length is `square`."""
    x = q.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, square - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(0, d))


class SplitTree:
    """Nodes of split points. A child is the subtree of the rows nearest to its point: another node, or a leaf, numbered.

    low[i, j] and high[i, j] of a node are the least and the largest distance between
    point i and the rows below child j.
    """

    def __init__(self, rows: np.ndarray, leaf: float, seed: int = 5):
        self.points: list[np.ndarray] = []
        self.children: list[list[tuple[bool, int]]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        #: what rounding can move a distance by, with room to spare
        self.slack = 1e-6 * (1 + float(np.sqrt((rows * rows).sum(axis=1).max(initial=0))))
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(rows)), None)]
        while todo:
            some, parent = todo.pop()
            points = self._spread(rows[some], leaf, rng) if len(some) > leaf else None
            if points is not None:
                far = distances(rows[some], points)
                own = far.argmin(axis=1)
            if points is None or (own == own[0]).all():
                me = (True, len(self.leaves))
                self.leaves.append(some)
            else:
                me = (False, len(self.points))
                low, high = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
                for j in range(len(points)):
                    if (own == j).any():
                        low[:, j], high[:, j] = far[own == j].min(axis=0), far[own == j].max(axis=0)
                self.points.append(points), self.low.append(low), self.high.append(high)
                self.children.append([(True, -1)] * len(points))
                todo += [(some[own == j], (me[1], j)) for j in range(len(points))]
            if parent:
                self.children[parent[0]][parent[1]] = me
        self.top = (True, 0) if not self.points else (False, 0)

    def _spread(self, rows: np.ndarray, leaf: float, rng: np.random.Generator) -> np.ndarray | None:
        """Split points far from each other, chosen greedily among some rows; None if all are equal."""
        degree = int(np.clip(-(-len(rows) // max(1, leaf)), 2, DEGREE))
        some = rows[rng.choice(len(rows), min(len(rows), 8 * degree), replace=False)]
        chosen = [0]
        far = distances(some, some[:1])[:, 0]
        while len(chosen) < degree and far.max() > self.slack:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            other = distances(rows, some[:1])[:, 0]
            return np.stack([some[0], rows[int(other.argmax())]]) if other.max() > self.slack else None
        return some[chosen]

    def deal(self, rows: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The leaf of each row, and for each node passed the ranges that these rows give."""
        out, seen, todo = np.zeros(len(rows), np.int64), {}, [(self.top, np.arange(len(rows)))]
        while todo:
            (is_leaf, k), some = todo.pop()
            if is_leaf:
                out[some] = k
            elif len(some):
                far = distances(rows[some], self.points[k])
                own = far.argmin(axis=1)
                low, high = np.full(self.low[k].shape, np.inf), np.full(self.low[k].shape, -np.inf)
                for j in np.unique(own).tolist():
                    low[:, j], high[:, j] = far[own == j].min(axis=0), far[own == j].max(axis=0)
                    todo.append((self.children[k][j], some[own == j]))
                seen[k] = (low, high)
        return out, seen

    def meet(self, x: np.ndarray, inner, outer) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the numbers of the anchors x whose annulus can hold rows of theirs.

        `inner` and `outer` give the radii of some anchors by their numbers; they are asked
        anew at each node, since an outer radius shrinks with what has been found.
        """
        todo = [(self.top, np.arange(len(x)))]
        while todo:
            (is_leaf, k), some = todo.pop()
            if is_leaf:
                yield k, some
                continue
            far = distances(x[some], self.points[k])
            low, high, slack = self.low[k], self.high[k], 2 * self.slack
            a, b = inner(some)[:, None] - slack, outer(some)[:, None] + slack
            alive = np.ones(far.shape, bool)
            for i in range(far.shape[1]):
                f = far[:, i : i + 1]
                alive &= (f - high[i] <= b) & (low[i] - f <= b) & (f + high[i] >= a)
            nearest = np.argsort(-far.min(axis=0))  # the nearest child is looked at first
            todo += [(self.children[k][j], some[alive[:, j]]) for j in nearest.tolist() if alive[:, j].any()]


def keyed(scores: np.ndarray) -> np.ndarray:
    """Numbers that order (score falling, position rising) at once: score * width - position."""
    return scores * scores.shape[1] - np.arange(scores.shape[1])


def best(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row among the columns that are ok, ties to the smaller id (columns ascend by it); NONE where there are fewer."""
    width, k = scores.shape[1], min(k, scores.shape[1])
    if width == 0:
        return np.full((len(scores), 0), NONE), np.full((len(scores), 0), NONE)
    if np.abs(scores).max(initial=0) < (1 << 61) // width:
        key = np.where(ok, keyed(scores), NONE)
        key = -np.sort(-np.partition(key, width - k, axis=1)[:, width - k :], axis=1)
        at = np.where(key == NONE, 0, -key % width)
    else:
        at = np.lexsort((-scores, ~ok))[:, :k]
        key = np.where(np.take_along_axis(ok, at, 1), 0, NONE)
    there = key != NONE
    return np.where(there, np.take_along_axis(scores, at, 1), NONE), np.where(there, ids[at], NONE)


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of each row."""
    s, i = np.concatenate([scores, more], axis=-1), np.concatenate([ids, of], axis=-1)
    order = np.lexsort((i, -s), axis=-1)[..., :k]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


class Anchors:
    """Anchors with what they look for: the first POSITIVES rows of their label, or the first NEGATIVES others in each window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, square: float, windows: np.ndarray | None):
        self.ids, self.labels, self.q, self.windows = ids, labels, q, windows
        x = q.astype(np.float64)
        self.x = np.hstack([x, np.zeros((len(q), 1))])
        self.reach = (x * x).sum(axis=1) + square
        shape = (len(q), POSITIVES) if windows is None else (len(q), windows.shape[1], NEGATIVES)
        self.scores, self.found = np.full(shape, NONE), np.full(shape, NONE)

    def radius(self, some: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows of a score lie."""
        return np.sqrt(np.maximum(0, self.reach[some] - 2.0 * score))

    def inner(self, some: np.ndarray) -> np.ndarray:
        return np.zeros(len(some)) if self.windows is None else self.radius(some, self.windows[some, :, 1].max(axis=1))

    def outer(self, some: np.ndarray) -> np.ndarray:
        """Where the last row that is still wanted may lie; beyond all if not enough is found."""
        if self.windows is None:
            least = self.scores[some, -1]
            return np.where(least == NONE, np.inf, self.radius(some, np.maximum(least, -(1 << 61))))
        least = np.maximum(self.windows[some, :, 0], self.scores[some, :, -1])
        return self.radius(some, least.min(axis=1))

    def look(self, some: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        """Compares some anchors with rows, which ascend by their ids."""
        if not len(some) or not len(ids):
            return
        scores = products(self.q[some], q)
        same = self.labels[some][:, None] == labels[None, :]
        if self.windows is None:
            own = same & (self.ids[some][:, None] == ids[None, :])
            for i, j in np.argwhere(own).tolist():
                same[i, j] = not (self.q[some[i]] == q[j]).all()
            s, i = best(scores, same, ids, POSITIVES)
            self.scores[some], self.found[some] = merged(self.scores[some], self.found[some], s, i, POSITIVES)
        else:
            for w in range(self.windows.shape[1]):
                lo, hi = self.windows[some, w, 0][:, None], self.windows[some, w, 1][:, None]
                ok = ~same & (scores >= np.maximum(lo, self.scores[some, w, -1][:, None])) & (scores <= hi)
                rows = np.flatnonzero(ok.any(axis=1))
                if len(rows):
                    s, i = best(scores[rows], ok[rows], ids, NEGATIVES)
                    at = some[rows]
                    self.scores[at, w], self.found[at, w] = merged(self.scores[at, w], self.found[at, w], s, i, NEGATIVES)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


class Miner:
    """The upper tree over all rows of a table, laid out in slices of its leaves."""

    def __init__(self, rows: DataFrame):
        self.spark, self.rows = rows.sparkSession, rows
        size = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
        self.n, self.d, self.square = size[0], size[1], float(size[2] or 0)
        keep = max(1, min(SAMPLE, SAMPLE_VALUES // max(1, self.d or 1)))
        some = rows.orderBy(F.xxhash64("vec_id", "q")).limit(keep).toArrow().combine_chunks()
        order = np.argsort(some.column("vec_id").to_numpy(), kind="stable")
        self.sample = (some.column("vec_id").to_numpy()[order], some.column("label").to_numpy()[order], matrix(some.column("q").combine_chunks(), self.d or 0)[order])
        leaf = max(LEAF_ROWS, self.n / MOST_LEAVES) * len(order) / max(1, self.n)
        self.tree = SplitTree(lifted(self.sample[2], self.square), max(2.0, leaf))
        self.tree.leaves = [np.zeros(0, np.int64)] * len(self.tree.leaves)
        self._lay_out()

    def _lay_out(self) -> None:
        """Deals all rows to the leaves and takes the ranges over all of them."""
        tree, square, d = self.spark.sparkContext.broadcast(self.tree), self.square, self.d

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, _ = tree.value.deal(lifted(matrix(b.column("q"), d), square))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], ["vec_id", "label", "q", "leaf"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for k, (low, high) in tree.value.deal(lifted(matrix(b.column("q"), d), square))[1].items():
                    old = seen.get(k, (low, high))
                    seen[k] = (np.minimum(old[0], low), np.maximum(old[1], high))
            rows = [(k, i, j, low[i, j], high[i, j]) for k, (low, high) in seen.items() for i, j in np.argwhere(np.isfinite(low)).tolist()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.float64()] * 2)], ["node", "i", "j", "low", "high"])

        self.dealt = written(self.rows.mapInArrow(deal, "vec_id long, label long, q array<int>, leaf int"), "dealt")
        ranges = self.rows.mapInArrow(measure, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        self.tree.low = [np.full(x.shape, np.inf) for x in self.tree.low]
        self.tree.high = [np.full(x.shape, -np.inf) for x in self.tree.high]
        for r in ranges.toLocalIterator():  # DEGREE squared rows for each of at most MOST_LEAVES nodes
            self.tree.low[r["node"]][r["i"], r["j"]], self.tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
        self.leaves = written(self.dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")), "leaves")

    def search(self, anchors: DataFrame, windows: int | None) -> DataFrame:
        """anchor, w, found, score of the rows that each anchor (anchor, vec_id, label, q and, for negatives, windows) looks for, as its slices give them."""
        state, square, d = self.spark.sparkContext.broadcast((self.tree, self.sample)), self.square, self.d
        extra = "" if windows is None else ", windows array<long>"
        columns = ["anchor", "vec_id", "label", "q"] + ["windows"] * (windows is not None)

        def read(b: pa.RecordBatch | pa.Table) -> Anchors:
            w = None if windows is None else matrix(b.column("windows"), 2 * windows).reshape(-1, windows, 2)
            return Anchors(b.column("vec_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("q"), d), square, w)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sample = state.value
            for b in batches:
                for k in range(0, b.num_rows, ANCHORS):
                    some = b.slice(k, ANCHORS)
                    a = read(some)
                    for s in range(0, len(sample[0]), 2048):  # a first bound of what is still wanted
                        a.look(np.arange(some.num_rows), *(x[s : s + 2048] for x in sample))
                    for leaf, who in tree.meet(a.x, a.inner, a.outer):
                        t = some.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), leaf), pa.int32()), *t.columns], ["leaf", *columns])

        routed = anchors.select(*columns).mapInArrow(route, f"leaf int, anchor long, vec_id long, label long, q array<int>{extra}")
        routed = written(routed, "routed")
        parts = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("parts"))
        cuts = written(self.leaves.join(parts, "leaf"), "cuts")  # a row a leaf
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        one = lambda k, c: F.pmod(F.xxhash64(*k), F.col(c)).cast("int")
        asked = routed.join(F.broadcast(cuts), "leaf").select("leaf", each("slices").alias("slice"), one(["anchor"], "parts").alias("part"), *columns)
        held = self.dealt.join(F.broadcast(cuts), "leaf").select("leaf", one(["vec_id", "q"], "slices").alias("slice"), each("parts").alias("part"), "vec_id", "label", "q")

        def match(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                left, right = left.combine_chunks(), right.combine_chunks()
                a = read(pa.RecordBatch.from_arrays([left.column(c).combine_chunks() for c in columns], columns))
                ids, labels, q = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), matrix(right.column("q").combine_chunks(), d)
                tree = SplitTree(lifted(q, square), EXACT)
                for leaf, who in tree.meet(a.x, a.inner, a.outer):
                    at = tree.leaves[leaf]
                    at = at[np.argsort(ids[at], kind="stable")]
                    a.look(who, ids[at], labels[at], q[at])
                names = left.column("anchor").to_numpy()
                scores, found = a.scores.reshape(len(names), -1, a.scores.shape[-1]), a.found.reshape(len(names), -1, a.scores.shape[-1])
                out = [(names[i], w, found[i, w, r], scores[i, w, r]) for i, w, r in np.argwhere(scores != NONE)]
            cols = list(zip(*out)) if out else [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64()])], ["anchor", "w", "found", "score"])

        by, n = ["leaf", "slice", "part"], partitions(self.spark)
        grouped = asked.repartition(n, *by).groupBy(*by).cogroup(held.repartition(n, *by).groupBy(*by))
        rows = grouped.applyInArrow(match, "anchor long, w int, found long, score long")
        k = POSITIVES if windows is None else NEGATIVES
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "found")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors that `is_anchor` (of vec_id) selects.

    A positive without a row in its window gives none, nor does an anchor without
    positives; a window of a negative positive_score is empty. Of equal scores the
    smaller vec_id comes first. Rows that share a vec_id but not label and vector are
    rows of their own. An empty table gives no rows; other columns are left out,
    whatever their names.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(quantised(vectors), "quantised")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    miner = Miner(rows)
    anchors = written(rows.where(F.coalesce(is_anchor, F.lit(False))).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    positives = written(miner.search(anchors, None).select("anchor", "rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # windows of whole scores: half of the positive's rounded up, to 95 % of it rounded down; empty ones hold nothing
    lo, hi = F.expr("positive_score div 2 + positive_score % 2"), F.expr("(positive_score div 100) * 95 + ((positive_score % 100) * 95) div 100")
    some = positives.where("positive_score >= 0").select("anchor", "rank", "positive_id", "positive_score", lo.alias("lo"), hi.alias("hi"))
    slots = F.array(*[F.coalesce(F.max(F.when(F.col("rank") == r + 1, F.col(c))), F.lit(empty)) for r in range(POSITIVES) for c, empty in (("lo", 1 << 61), ("hi", NONE))])
    wanted = anchors.join(some.groupBy("anchor").agg(slots.alias("windows")), "anchor")
    negatives = miner.search(wanted, POSITIVES).select("anchor", (F.col("w") + 1).alias("slot"), F.col("rank"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = some.select("anchor", F.col("rank").alias("slot"), "positive_id", "positive_score").join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(negatives, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(v.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
