"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Two fingerprints that differ in at most `most` bits agree on at least `parts - most`
of `parts` blocks, so each choice of that many blocks is a join key. The number of
blocks follows the number of distinct fingerprints, so that a key has few of them.
Copies of a fingerprint collapse before the join. A key that many fingerprints
share is dealt out over pairs of slices, and each group of a key returns a spanning
forest of its links, never all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import partitions, spread_join, table, text_or_empty, written
from .components import components
from .op6_exact import keep_rows, row_key

#: Fingerprints of a key that one group compares with each other at once.
SLICE = 2000


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text over shingles of words, repeats included; 0 if it has no word."""
    return near_copies.simhash(near_copies.shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed 64-bit) of each row. Null text counts as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "", words, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_keys(n: int, most: int) -> list[list[tuple[int, int]]]:
    """For each key the (shift, width) of its blocks: as few blocks as leave about one of n fingerprints to a key."""
    parts = most + 1
    while parts < most + 5 and (parts - most) * (64 // parts) < n.bit_length():
        parts += 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(blocks, parts - most)]


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among some fingerprints."""
    edges = []
    left = np.arange(len(fps))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= most
            if near.any():
                found = left[near]
                edges += [(i, j) for j in found]
                stack += found.tolist()
                left = left[~near]
    return edges


def links(nodes: DataFrame, most: int) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints `fp` that differ in at most `most` bits: their components are those of all links."""
    spark = nodes.sparkSession
    n = nodes.count()
    keys = block_keys(n, most)
    packed = []
    for k, blocks in enumerate(keys):
        value = F.lit(k).cast("long")
        for shift, width in blocks:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        packed.append(value)
    keyed = nodes.select("fp", F.explode(F.array(*packed)).alias("key"))
    counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")), "counts")
    shared = spread_join(keyed, counts, "key", "n", len(keys) * n)
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = (
        shared.select("key", "fp", "slices", own.alias("own"), other.alias("other"))
        .select("key", "fp", (F.least("own", "other") * F.col("slices") + F.greatest("own", "other")).alias("unit"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            out, rest = grouped(t, False)
            yield out
        if rest is not None:
            yield grouped(rest, True)[0]

    def grouped(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
        key, unit = t.column("key").to_numpy(), t.column("unit").to_numpy()
        fps = t.column("fp").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        done = len(starts) - 1 if last else len(starts) - 2
        u, v = [], []
        for a, e in zip(starts[: max(done, 0)].tolist(), starts[1 : max(done, 0) + 1].tolist()):
            some = fps[a:e].view(np.uint64)
            for i, j in forest(some, most):
                u.append(fps[a + i])
                v.append(fps[a + j])
        out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        return out, None if last else t.slice(int(starts[-2]) if len(starts) > 1 else 0)

    return dealt.repartition(partitions(spark), "key", "unit").sortWithinPartitions("key", "unit", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id per row.

    Null text counts as empty. Repeated rows and equal texts share a fingerprint, hence
    a component. component_id is the smallest doc_id of the component, null only where
    all its doc_ids are null. Long texts count whole. An empty table gives no rows. Other
    columns are left out, whatever their names.
    """
    rows = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), most))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = written(spread_join(placed, ids, "root", "_n", placed.count()).select("fp", "component_id", "n"), "named")
    return spread_join(rows, named, "fp", "n", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked_fingerprints(nodes: DataFrame, most: int = 4) -> DataFrame:
    """node, key: nodes (node, fp, each once) of one key are those whose fingerprints reach each other over links of at most `most` bits."""
    nodes = nodes.where("fp IS NOT NULL")
    fps = written(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fps")
    roots = components(links(fps.select("fp"), most))
    placed = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("key")), "placed")
    return spread_join(nodes, placed, "fp", "n", nodes.count()).select("node", "key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of its smallest doc_id, a null one only if it has no other; then of the smallest key.

    Columns stay as they are. Rows of null or repeated doc_id are told apart by their
    texts; rows equal in doc_id and text count once. Null and empty texts are equal; long
    texts count whole; an empty table gives no rows. Texts whose fingerprints of five-word
    shingles link by blocks are candidates, and so are those that share a band of
    near_copies; those of similarity 0.8 are linked. The bounds of near_duplicates are
    the contract of its query only.
    """
    key = row_key(docs["doc_id"], text_or_empty().cast("string").cast("binary"))
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.alias("row"))
    rows = written(near_copies.marks(named), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = written(rows.groupBy("node").agg(first, F.any_value("fp").alias("fp")), "nodes")
    groups = linked_fingerprints(nodes.select("node", "fp"))
    roots = components(near_copies.similar_links(named, rows, groups))
    placed = nodes.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = written(placed.groupBy("root").agg(F.min("first").alias("first")).select("first.row"), "kept")
    return keep_rows(docs, kept, key, rows.select("row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
