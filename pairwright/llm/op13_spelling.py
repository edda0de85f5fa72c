"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One edit changes the letter counts of a word by an L1 distance of at most two, or one
where it changes the length. Words of each length are dealt into the cells of a k-d
tree that is fitted on a bounded sample. A word goes to every cell of its own length
within distance two, and of the lengths beside it within distance one; there a tree
over the cell's words prunes by its boxes, and what is left is verified letter by
letter. Each cell returns counts and the best neighbour of a word, never its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, text_or_empty, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters have a dimension each; other characters share the last ones.
LETTERS, DIMS = 90, 96
#: Words whose letter counts fit the trees that deal out words, and words aimed at in a cell.
SAMPLE, CELL = 40_000, 2048
#: Words of a leaf of the tree in a cell, and queries compared with a leaf at once.
LEAF, BLOCK = 24, 2048
#: Letter counts and code points of a cell's slice, queries that a task of a slice takes, words of an array.
SLICE_VALUES, QUERY_PART, ARRAY_CHARS, ARRAY_WORDS = 4_000_000, 1_000_000, 400_000, 16_384


def low(run: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted_words(docs: DataFrame, damage: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word, n of the runs of letters of all documents; where `damage` divides a run's checksum with its doc_id, one of its letters is deleted first."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty().cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", low(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<i4").reshape(len(words), -1)


def letter_counts(c: np.ndarray) -> np.ndarray:
    dim = np.where(c < 123, c - 97, np.where((c >= 0xC0) & (c <= 0xFF), c - 0xC0 + 26, LETTERS + c % (DIMS - LETTERS)))
    dim = np.where(dim < 0, LETTERS + c % (DIMS - LETTERS), dim)
    flat = dim + np.arange(len(c))[:, None] * DIMS
    return np.bincount(flat.ravel(), minlength=len(c) * DIMS).reshape(len(c), DIMS).astype(np.int32)


class LetterTree:
    """A k-d tree over letter counts: nodes (dimension, threshold, left, right), leaves (None, number, rows)."""

    def __init__(self, counts: np.ndarray, leaf: float):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.low, self.high = counts.min(axis=0), counts.max(axis=0)
        todo = [(np.arange(len(counts)), None)]
        while todo:
            rows, parent = todo.pop()
            k = len(self.nodes)
            if parent is not None:
                self.nodes[parent[0]][2 + parent[1]] = k
            cut = self._cut(counts[rows]) if len(rows) > leaf else None
            if cut is None:
                self.nodes.append((None, self.leaves, rows))
                self.leaves += 1
            else:
                self.nodes.append([*cut, 0, 0])
                left = counts[rows, cut[0]] <= cut[1]
                todo += [(rows[~left], (k, 1)), (rows[left], (k, 0))]

    @staticmethod
    def _cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The dimension and threshold that halve the rows best; None if all are equal."""
        best, middle = None, len(counts) // 2
        spread = np.flatnonzero(counts.min(axis=0) != counts.max(axis=0))
        if not len(spread):
            return None
        some = np.partition(counts[:, spread], middle, axis=0)[middle]
        for t in (some, some - 1):
            part = (counts[:, spread] <= t).sum(axis=0)
            even = np.minimum(part, len(counts) - part)
            d = int(even.argmax())
            if even[d] and (best is None or even[d] > best[0]):
                best = (int(even[d]), int(spread[d]), int(t[d]))
        return best[1:] if best else None

    def slim(self) -> LetterTree:
        """Without the rows of its leaves."""
        self.nodes = [(None, n[1], None) if n[0] is None else tuple(n) for n in self.nodes]
        return self

    def cells(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(counts), np.int64), [(0, np.arange(len(counts)))]
        while todo:
            k, rows = todo.pop()
            n = self.nodes[k]
            if n[0] is None:
                out[rows] = n[1]
            elif len(rows):
                left = counts[rows, n[0]] <= n[1]
                todo += [(n[2], rows[left]), (n[3], rows[~left])]
        return out

    def near(self, counts: np.ndarray, most: int, bounded: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """Leaves with the rows of `counts` whose L1 distance to the leaf's box is at most `most`, and the leaf's own rows.

        `bounded`: the tree holds all there is, so that the box of its own rows is the outermost.
        """
        columns = np.ascontiguousarray(counts.T)
        rows, far, box = np.arange(len(counts)), np.zeros(len(counts), np.int32), {}
        if bounded:
            for d, (a, b) in enumerate(zip(self.low.tolist(), self.high.tolist())):
                far = far + np.maximum(0, np.maximum(a - columns[d], columns[d] - b))
                box[d] = (a, b)
            rows = np.flatnonzero(far <= most)
        todo = [(0, rows, far[rows], box)]
        while todo:
            k, rows, far, box = todo.pop()
            n = self.nodes[k]
            if n[0] is None:
                yield n[1], rows, n[2]
                continue
            d, t = n[0], n[1]
            v = columns[d][rows]
            lo, hi = box.get(d, (-(1 << 30), 1 << 30))
            was = np.maximum(0, np.maximum(lo - v, v - hi))
            for child, a, b in ((n[2], lo, min(hi, t)), (n[3], max(lo, t + 1), hi)):
                new = far - was + np.maximum(0, np.maximum(a - v, v - b))
                keep = new <= most
                if keep.any():
                    todo.append((child, rows[keep], new[keep], box | {d: (a, b)}))


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits of parities of letter counts: a unit of L1 distance flips one bit at most."""
    odd = np.zeros((len(counts), 64), np.uint8)
    for k in range(0, DIMS, 64):
        odd[:, : min(64, DIMS - k)] ^= (counts[:, k : k + 64] & 1).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.uint64).ravel()


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points a and b differ by exactly one replaced code point, or one more in the longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


class Cell:
    """The words of a cell, all of one length, with their tree."""

    def __init__(self, words: list[str], ns: np.ndarray):
        # by falling n and then by word, so that the best of some is the first
        order = np.lexsort((np.argsort(np.argsort(np.array(words, object))), -ns))
        self.words, self.ns = [words[i] for i in order], ns[order]
        self.codes = codes(self.words)
        self.counts = letter_counts(self.codes)
        self.tree, self.bits = LetterTree(self.counts, LEAF), signatures(self.counts)

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word how many of the cell's are one edit away, and the first of them (the cell's size if none)."""
        asked = codes(words)
        counts, most = letter_counts(asked), 2 if asked.shape[1] == self.codes.shape[1] else 1
        bits, n_near, first = signatures(counts), np.zeros(len(words), np.int64), np.full(len(words), len(self.words))
        for _, rows, own in self.tree.near(counts, most, bounded=True):
            for a in range(0, len(rows), BLOCK):
                some = rows[a : a + BLOCK]
                i, j = np.nonzero(np.bitwise_count(bits[some][:, None] ^ self.bits[own][None, :]) <= most)
                i, j = some[i], own[j]
                step = max(1, SLICE_VALUES // asked.shape[1])
                for k in range(0, len(i), step):
                    p, q = i[k : k + step], j[k : k + step]
                    ok = one_edit(asked[p], self.codes[q])
                    np.add.at(n_near, p[ok], 1)
                    np.minimum.at(first, p[ok], q[ok])
        return n_near, first


def fitted(words: DataFrame) -> dict[int, LetterTree]:
    """Trees of the lengths that have more words than a cell, from the letter counts of at most SAMPLE words."""
    sizes = words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    large = {r["length"]: r["n"] for r in sizes.toLocalIterator()}  # at most a row per CELL words, and few lengths are common
    if not large:
        return {}
    some = words.join(F.broadcast(sizes.select("length")), F.char_length("word") == F.col("length"), "left_semi")
    some = some.where(F.xxhash64("word").bitwiseAND(0xFFFFFF) <= (1 << 24) * min(1.0, 1.1 * SAMPLE / sum(large.values()))).select("word")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            rows = [letter_counts(codes([w]))[0].tolist() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, words), pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["length", "counts"])

    got = some.mapInArrow(counts, "length int, counts array<int>").limit(2 * SAMPLE).toArrow()
    lengths, rows = got.column("length").to_numpy(), got.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    out = {}
    for length, n in large.items():
        own = rows[lengths == length]
        if len(own):
            out[length] = LetterTree(own, max(8.0, CELL * len(own) / n)).slim()
    return out


ROUTED = "length int, cell int, asked boolean, own int, words array<string>, ns array<long>"


def routed(words: DataFrame, trees: dict[int, LetterTree]) -> DataFrame:
    """Words in the cells that hold them, and, asked, in those where they may have neighbours: arrays of words of one length `own`."""
    trees = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        chars = 0
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                held.append((w, n))
                chars += len(w)
                if chars >= 4_000_000:
                    yield from dealt(held)
                    held, chars = [], 0
        yield from dealt(held)

    def dealt(held: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for own, some in groupby(sorted(held, key=lambda x: len(x[0])), lambda x: len(x[0])):
            some = list(some)
            step = max(1, min(ARRAY_WORDS, ARRAY_CHARS // own))
            for k in range(0, len(some), step):
                words, ns = zip(*some[k : k + step])
                counts = letter_counts(codes(list(words)))
                for length in (own, own - 1, own + 1):
                    tree = trees.value.get(length)
                    if length == own:
                        at = tree.cells(counts) if tree else np.zeros(len(words), np.int64)
                        order = np.argsort(at, kind="stable")
                        for cell, part in groupby(order.tolist(), lambda i: at[i]):
                            part = list(part)
                            rows.append((own, int(cell), False, own, [words[i] for i in part], [ns[i] for i in part]))
                    found = tree.near(counts, 2 if length == own else 1) if tree else [(0, np.arange(len(words)), None)]
                    for cell, part, _ in found:
                        rows.append((length, cell, True, own, [words[i] for i in part.tolist()], None))
                if len(rows) > 4000:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["length", "cell", "asked", "own", "words", "ns"])

    return words.select("word", "n").mapInArrow(run, ROUTED)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of the words (word, n; distinct) that have others one edit away: how many, and the one of largest n, ties to the smallest in code-point order."""
    spark = words.sparkSession
    placed = written(routed(words, fitted(words)), "routed")
    size = F.size("words")
    sizes = placed.groupBy("length", "cell").agg(F.sum(F.when(F.col("asked"), 0).otherwise(size)).alias("held"), F.sum(F.when(F.col("asked"), size).otherwise(0)).alias("asked_for"))
    # large cells are cut into slices, and what is asked of one into parts; there is a row a cell
    cuts = sizes.where("held > 0").select("length", "cell", F.ceil(F.col("held") * F.greatest("length", F.lit(DIMS)) / SLICE_VALUES).cast("int").alias("slices"), F.ceil(F.greatest("asked_for", F.lit(1)) / QUERY_PART).cast("int").alias("parts"))
    mark = F.xxhash64(F.element_at("words", 1))
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    one = lambda c: F.array(F.pmod(mark, F.col(c)).cast("int"))
    units = placed.join(cuts, ["length", "cell"]).select("length", "cell", "asked", "own", "words", "ns", F.explode(F.when(F.col("asked"), each("slices")).otherwise(one("slices"))).alias("slice"), "parts")
    units = units.select("length", "cell", "slice", F.explode(F.when(F.col("asked"), one("parts")).otherwise(each("parts"))).alias("part"), "asked", "own", "words", "ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, words, ns, waiting = None, None, [], [], {}

        def answered(least: int) -> Iterator[pa.RecordBatch]:
            """Searches for what waits, of each length together, if it is at least so many words."""
            for own, some in list(waiting.items()):
                if len(some) >= least:
                    n_near, first = cell.search(waiting.pop(own))
                    at = np.flatnonzero(n_near)
                    best = first[at].tolist()
                    cols = [pa.array([some[i] for i in at.tolist()], pa.string()), pa.array(n_near[at]), pa.array(cell.ns[best]), pa.array([cell.words[i] for i in best], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["word", "n_near", "form_n", "form"])

        for b in batches:
            for length, c, s, p, asked, own, some, n in zip(*(b.column(x).to_pylist() for x in ("length", "cell", "slice", "part", "asked", "own", "words", "ns"))):
                if (length, c, s, p) != now:
                    yield from answered(1)
                    now, cell, words, ns = (length, c, s, p), None, [], []
                if not asked:
                    words += some
                    ns += n
                elif words:
                    cell = cell or Cell(words, np.array(ns, np.int64))
                    waiting.setdefault(own, []).extend(some)
                    yield from answered(min(ARRAY_WORDS, max(1, ARRAY_CHARS // own)))
        yield from answered(1)

    order = ["length", "cell", "slice", "part"]
    found = units.repartition(partitions(spark), *order).sortWithinPartitions(*order, "asked").mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form; no cycles). Each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of some distinct words (word, n).

    A word's form is its neighbour of largest n, if that is at least twice its own, so
    that chains of forms end. Words without neighbours have n_near 0, no form, and are
    their own root. Neighbours of equal n: the smallest in code-point order. An empty
    table gives no rows.
    """
    near = words.select("word", "n").join(neighbours(words), "word", "left")
    is_form = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    named = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling(docs: DataFrame) -> DataFrame:
    """Variants of the words of all documents.

    Null and empty texts have no words; a null doc_id counts as an empty one where runs are
    damaged; repeated rows count each; texts and runs of any length count whole. Other
    columns are left out, whatever their names. An empty table gives no rows.
    """
    return variants(written(counted_words(docs), "words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling(table(spark, sf_dir, "documents"))
