"""Sharding by best-fit-decreasing bin packing of groups of equal texts.

Groups larger than a small share of a shard are few for any input, at most
4 x partitions x shards; the driver packs these. All other groups are dealt to the
tasks by their digest; each task packs its groups, largest first, into the share
of every shard's remaining room that its bytes are of all, so that shards end up
with near equal bytes. A group that exceeds a shard is cut into runs of copies.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import partitions, table, text_or_empty, written


#: Groups that a task packs, while there are fewer tasks than shuffle partitions.
GROUPS_A_TASK = 20_000


class CapacityTree:
    """Bins by remaining room: a balanced binary tree over the room's values, of which only used paths are stored."""

    def __init__(self, largest: int):
        self.depth = max(1, int(largest).bit_length())
        self.count: list[dict[int, int]] = [{} for _ in range(self.depth + 1)]  # by level: prefix -> bins below
        self.bins: dict[int, list[int]] = {}

    def insert(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        for level, counts in enumerate(self.count):
            p = room >> (self.depth - level)
            n = counts.get(p, 0) + by
            if n:
                counts[p] = n
            else:
                del counts[p]

    def _least(self, level: int, prefix: int) -> int:
        for below in range(level + 1, self.depth + 1):
            prefix = prefix * 2 if prefix * 2 in self.count[below] else prefix * 2 + 1
        return prefix

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Room and bin of least room that is at least `size`, taken out; None if there is none."""
        if size >> self.depth:
            return None
        if size in self.bins:
            return self._pop(size)
        for level in range(self.depth, 0, -1):  # the nearest larger sibling on the path up
            p = size >> (self.depth - level)
            if not p & 1 and p + 1 in self.count[level]:
                return self._pop(self._least(level, p + 1))
        return None

    def pop_roomiest(self) -> tuple[int, int]:
        prefix = 0
        for level in range(1, self.depth + 1):
            prefix = prefix * 2 + 1 if prefix * 2 + 1 in self.count[level] else prefix * 2
        return self._pop(prefix)

    def _pop(self, room: int) -> tuple[int, int]:
        bins = self.bins[room]
        found = bins.pop(0)
        if not bins:
            del self.bins[room]
        self._change(room, -1)
        return room, found


def fit_into(sizes: list[int], rooms: list[int]) -> list[int]:
    """The bin of each size, bins given by their room; what fits nowhere goes where most room is left, below zero if need be."""
    low = min(0, min(rooms))
    shift = sum(sizes) - low  # rooms stay positive
    tree, out = CapacityTree(max(rooms) + shift), [0] * len(sizes)
    for b, r in enumerate(rooms):
        tree.insert(r + shift, b)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room, b = tree.pop_tightest(sizes[i] + shift) or tree.pop_roomiest()
        tree.insert(room - sizes[i], b)
        out[i] = b
    return out


def fair_share(total: int, shards: int, rows: list[tuple[int, int]]) -> int:
    """Bytes to a shard where rows (size, how many) that exceed it have shards of their own."""
    share = -(-total // shards)
    while True:
        over = sum(n for size, n in rows if size > share)
        left = total - sum(size * n for size, n in rows if size > share)
        new = -(-left // (shards - over)) if over < shards else share
        if new >= share:
            return share
        share = new


def level_rooms(loads: list[int], rest: int) -> list[int]:
    """Room of each shard up to the level at which all rooms together hold the rest."""
    held, filled = sorted(loads), 0
    for k, load in enumerate(held):
        if k + 1 == len(held) or (k + 1) * held[k + 1] - filled - load >= rest:
            level = -(-(rest + filled + load) // (k + 1))
            return [max(0, level - x) for x in loads]
        filled += load
    return []


def numbered(df: DataFrame, group: str, salts: int) -> DataFrame:
    """Adds `slot`, a gapless number from 0 in each group by (salt of doc_id, doc_id): no window holds a whole group.

    The counts of all (group, salt) are at most groups x salts rows.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)))
    counts = df.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(group, "_salt").orderBy("doc_id", "text_crc32", "size")
    return (
        df.withColumn("_in", F.row_number().over(inner) - 1)
        .join(firsts, [group, "_salt"])
        .withColumn("slot", (F.col("_first") + F.col("_in")).cast("long"))
        .drop("_salt", "_first", "_in")
    )


def sharded(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row, under the law `bytes`.

    size: UTF-8 bytes of the text plus `overhead`. Null text counts as empty, and is
    equal to it. Equal texts share a shard unless they exceed it together; repeated
    rows each get a slot. Rows of null doc_id are placed like others. grown_shard is
    null under this law. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "groups").withColumn("bytes", F.col("n") * F.col("size"))
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(partitions(spark), -(-n_groups // GROUPS_A_TASK)))
    capacity = -(-total // shards)
    limit = max(1, capacity // (4 * tasks))

    large = [r for r in groups.where(F.col("bytes") > limit).orderBy(F.desc("bytes"), "digest").toLocalIterator()] if total else []
    capacity = fair_share(total, shards, [(r["size"], r["n"]) for r in large])
    pieces: list[tuple[int, int, int, int]] = []  # group, first copy, copies, bytes
    for g, r in enumerate(large):
        most = max(1, capacity // r["size"])
        pieces += [(g, a, min(most, r["n"] - a), min(most, r["n"] - a) * r["size"]) for a in range(0, r["n"], most)]
    placed = fit_into([p[3] for p in pieces], [capacity] * shards)
    loads = [0] * shards
    runs: dict[int, list[tuple[int, int]]] = {}
    for (g, first, _, size), shard in zip(pieces, placed):
        loads[shard] += size
        runs.setdefault(g, []).append((first, shard))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("shard", T.IntegerType())])))])
    large_runs = spark.createDataFrame([(bytes(r["digest"]), runs[g]) for g, r in enumerate(large)], schema)
    small_total = max(1, total - sum(loads))
    rooms = level_rooms(loads, small_total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = list(batches)
        digests = [d for b in t for d in b.column("digest").to_pylist()]
        sizes = [s for b in t for s in b.column("bytes").to_pylist()]
        if not digests:
            return
        share = sum(sizes) / small_total
        at = fit_into(sizes, [round(r * share) for r in rooms])
        for k in range(0, len(digests), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(digests[k : k + 100_000], pa.binary()), pa.array(at[k : k + 100_000], pa.int32())], ["digest", "shard"])

    small = (
        groups.where(F.col("bytes") <= limit)
        .select("digest", "bytes")
        .repartition(tasks, "digest")
        .sortWithinPartitions(F.desc("bytes"), "digest")
        .mapInArrow(pack, "digest binary, shard int")
    )
    # at most 4 x tasks x shards groups are large, whatever the input
    marked = rows.join(F.broadcast(large_runs), "digest", "left")
    of_small = marked.where("runs IS NULL").drop("runs").join(small, "digest")
    of_large = marked.where("size(runs) = 1").withColumn("shard", F.col("runs")[0]["shard"]).drop("runs")
    cut = numbered(marked.where("size(runs) > 1"), "digest", partitions(spark))
    run = F.array_max(F.filter("runs", lambda r: r["first"] <= F.col("slot")))
    of_cut = cut.withColumn("shard", run["shard"]).drop("runs", "slot")
    all_rows = written(of_small.unionByName(of_large).unionByName(of_cut).select("doc_id", "size", "text_crc32", "shard"), "placed")
    return numbered(all_rows, "shard", partitions(spark)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
