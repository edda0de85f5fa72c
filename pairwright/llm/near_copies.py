"""Near copies by shingle similarity: SimHash blocks and min-hash bands for candidates, shingle sets for the decision.

Two texts are linked if the Jaccard similarity of their sets of shingles is at least
`LEAST`. Candidates are all texts whose SimHash fingerprints link by blocks (the caller
gives them as groups) and, as a pair at 0.8 mostly differs in more bits than blocks can
bridge, those that share a band: a text's min-hashes are cut into bands, each a join
key; at similarity s a pair shares a key with probability 1 - (1 - s ** ROWS) ** BANDS,
0.9996 at 0.8. Texts of a group or key are compared by their sets themselves, or,
beyond `SKETCH` shingles, by the smallest hashes of these. Texts of equal sets collapse
before the join, groups and keys of equal members count once, and one that many share
is dealt out over pairs of slices; each returns a spanning forest of its links.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small, spread_join, written

WORDS, LEAST = 5, 0.8
#: BANDS keys of ROWS min-hashes each.
BANDS, ROWS = 20, 5
#: Most hashes of a text that are compared: all shingles of a text of up to that many.
SKETCH = 2048
#: Texts of a key that one group compares with each other at once.
SLICE = 2000

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the shingles of words in their order, repeats included; one of a text of fewer words, none of no word."""
    import xxhash

    parts = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = len(parts)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, seed)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = n - words + 1
    return np.fromiter((digest(joined[a:e], seed) for a, e in zip(starts[:m].tolist(), ends[words - 1 :].tolist())), np.uint64, m)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, repeats included: a bit is 1 if set in over half of them; 0 if there are none."""
    m = len(hashes)
    if not m:
        return 0
    rows = -(-m // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:m] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).reshape(rows, 255, 64)
    ones = np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # a sum of 255 bits fits a byte
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def node_of(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles (sorted hashes)."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed 64-bit keys of the bands of a set of shingles; none of an empty one."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        mixed = hashes[None, k : k + 4096] * _A[:, None] + _B[:, None]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """The smallest SKETCH of sorted hashes, by their upper 32 bits; one zero byte follows if that isn't all of them."""
    return (hashes[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() + (b"\0" if len(hashes) > SKETCH else b"")


def similar(sketches: list[bytes], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among some texts.

    Where a sketch isn't whole, both sets are compared up to the smaller of their last hashes.
    """
    sizes = np.array([len(s) // 4 for s in sketches])
    last = np.array([np.frombuffer(s, "<u4", n)[-1] if len(s) % 4 else 0xFFFFFFFF for s, n in zip(sketches, sizes)], np.uint32)
    values, label = np.unique(np.concatenate([np.frombuffer(s, "<u4", n) for s, n in zip(sketches, sizes)]), return_inverse=True)
    limit = np.searchsorted(values, last, "right")  # labels below count
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    sets = [label[a:e] for a, e in zip(firsts, firsts[1:])]
    whole, mark = limit == len(values), np.zeros(len(values), bool)
    edges, left = [], np.arange(len(sketches))
    # the sets of `left` one after the other, gathered anew when half of them are gone
    held = left
    flat, at = label, firsts[:-1]
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            if 2 * len(left) < len(held):
                held = left
                flat = np.concatenate([sets[j] for j in held])
                at = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
            mark[sets[i]] = True
            both = mark[flat]
            mark[sets[i]] = False
            mine, theirs = sizes[i], sizes[held]
            if not (whole[i] and whole[held].all()):
                cap = np.minimum(limit[i], limit[held])
                inside = flat < np.repeat(cap, sizes[held])
                both &= inside
                mine, theirs = np.searchsorted(sets[i], cap), np.add.reduceat(inside, at, dtype=np.int64)
            common = np.add.reduceat(both, at, dtype=np.int64)
            near = common >= least * (mine + theirs - common)
            found = np.intersect1d(held[near], left, assume_unique=True)
            if len(found):
                edges += [(int(i), int(j)) for j in found]
                stack += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)
    return edges


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, row, node, fp, keys of each row of docs (doc_id, text, row). Null text counts as empty; the set of no shingle has no fp and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [np.unique(shingle_hashes(t or "", WORDS)) for t in b.column("text").to_pylist()]
            nodes, keys = pa.array(map(node_of, sets), pa.binary()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))
            fps = np.array([simhash(s) for s in sets], np.uint64).view(np.int64)
            fps = pa.array(fps, mask=np.array([len(s) == 0 for s in sets], bool))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), nodes, fps, keys], ["doc_id", "row", "node", "fp", "keys"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row binary, node binary, fp long, keys array<long>")


def sketches(docs: DataFrame) -> DataFrame:
    """node and sketch of the rows of docs; a task sends each node once, so that one that most rows share stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                sets = [np.unique(shingle_hashes(t or "", WORDS)) for t in b.column("text").slice(k, 500).to_pylist()]
                fresh = {n: s for n, s in zip(map(node_of, sets), sets) if n not in sent}
                sent.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(map(sketch, fresh.values()), pa.binary())], ["node", "sketch"])

    return docs.select("text").mapInArrow(run, "node binary, sketch binary")


def similar_links(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Spanning links (u, v) among the nodes of `rows` = marks(docs); `groups` has the node and key of the candidates by fingerprints, each node once."""
    spark = docs.sparkSession
    # a key of a band that is also one of a group only adds candidates
    keyed = written(rows.select("node", F.explode("keys").alias("key")).unionByName(groups.select("node", "key")).distinct(), "keyed")
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"members{k}") for k in (1, 2)]).where("n > 1")
    counts = members.groupBy("n", "members1", "members2").agg(F.min("key").alias("key")).select("key", "n")
    counts = written(counts.withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")), "counts")
    shared = written(spread_join(keyed, counts, "key", "n", keyed.count()), "shared")
    sets = sketches(docs).join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    unit = F.least("own", "other") * F.col("slices") + F.greatest("own", "other")
    dealt = shared.select("key", "node", "slices", own.alias("own"), other.alias("other")).select("key", "node", unit.alias("unit")).join(sets, "node")

    def linked(key: tuple | None, nodes: list[bytes], some: list[bytes]) -> pa.RecordBatch:
        edges = similar(some) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in edges], pa.binary()), pa.array([nodes[j] for _, j in edges], pa.binary())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, some = None, [], []
        for b in batches:
            for key, unit, node, s in zip(*(b.column(c).to_pylist() for c in ("key", "unit", "node", "sketch"))):
                if (key, unit) != now:
                    yield linked(now, nodes, some)
                    now, nodes, some = (key, unit), [], []
                nodes.append(node)
                some.append(s)
        yield linked(now, nodes, some)

    return dealt.repartition(partitions(spark), "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(run, "u binary, v binary").distinct()
