"""Paired bootstrap of two scorers over the same cells (pair_id, label_index, y, a, b)."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import blocks as blocks_
from ..functions.md5 import first48
from ..functions.shared import dense_id, written

#: Bytes of weights that are broadcast at once, cells of a run aimed at, and numbers of its cells and reps that are summed at once.
WEIGHT_BYTES, BLOCK, RUN_VALUES = 64_000_000, 65_536, 2_000_000
#: Labels of all kinds of pairs (those of the same labels and scores) that are held at once, and pairs of a slice at most.
ENTRIES, SLICE = 500_000, 32_768


def hash48(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long")


def draw_weights(pairs: DataFrame, reps: int, seed: int = 13) -> DataFrame:
    """rep, pair_id, w: each rep draws as many pairs as there are, with replacement; w counts how often. Undrawn pairs have no row."""
    ranked = dense_id(pairs.select("pair_id").distinct(), ["pair_id"], "_r")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    slots = ranked.join(F.broadcast(n)).select("_r", "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = slots.select("rep", F.pmod(hash48(F.col("rep") * F.col("_n") + F.col("_r"), seed), F.col("_n")).alias("_r"))
    return drawn.groupBy("rep", "_r").agg(F.count(F.lit(1)).alias("w")).join(ranked, "_r").select("rep", "pair_id", "w")


def _pair_parts(cells: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per pair what F1 and AP@k need of it, for both scorers."""
    out = cells
    for s in "ab":
        order = Window.partitionBy("pair_id").orderBy(F.desc(s), "label_index")
        out = out.withColumn(f"r_{s}", F.row_number().over(order)).withColumn(f"tp_{s}", F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda s: F.when((F.col(f"r_{s}") <= k) & (F.col("y") == 1), F.col(f"tp_{s}") / F.col(f"r_{s}")).otherwise(0.0)
    hit = lambda s: F.sum(F.when(F.col(s) >= threshold, F.col("y")).otherwise(0))
    said = lambda s: F.count_if(F.col(s) >= threshold)
    per = out.groupBy("pair_id").agg(F.sum("y").alias("P"), *[f(s).alias(f"{n}_{s}") for s in "ab" for n, f in (("hit", hit), ("said", said), ("ap", lambda s: F.sum(at(s))))])
    most = F.least("P", F.lit(k))
    return per.select("pair_id", "P", "hit_a", "hit_b", "said_a", "said_b", *[F.when(F.col("P") > 0, F.col(f"ap_{s}") / most).otherwise(0.0).alias(f"ap_{s}") for s in "ab"])


def draws(n: int, slots: range, seed: int) -> np.ndarray:
    """The pair (by rank) that each slot draws: the first 12 hex digits of md5(slot:seed), modulo n."""
    return np.concatenate([x % n for x in first48(slots, b":%d" % seed)])


def drawn_of(n: int, rep: int, seed: int) -> np.ndarray:
    """How often a rep draws each of n pairs (by rank): bytes, or four of them if a pair is drawn more than 255 times."""
    w = np.zeros(n, np.uint32)
    for x in first48(range(rep * n, (rep + 1) * n), b":%d" % seed):
        np.add.at(w, x % n, np.uint32(1))
    return w.astype(np.uint8) if w.max() < 256 else w


def weight_block(spark: SparkSession, n: int, reps: range, seed: int) -> np.ndarray:
    """How often each of n pairs (by rank) is drawn in each of some reps: pairs x reps. A task draws for a rep; what comes back is a byte a pair and rep, four if a pair is drawn more than 255 times."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep in b.column("id").to_pylist():
                w = drawn_of(n, rep, seed)
                yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([w.astype(w.dtype.newbyteorder("<")).tobytes()], pa.binary())], ["rep", "w"])

    out = np.zeros((n, len(reps)), np.uint8)
    tasks = min(len(reps), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = spark.range(reps.start, reps.stop, 1, tasks).mapInArrow(draw, "rep long, w binary").toArrow()
    for rep, w in zip(drawn.column("rep").to_pylist(), drawn.column("w")):
        drawn_ = np.frombuffer(w.as_buffer(), "u1" if len(w.as_buffer()) == n else "<u4")
        out = out.astype(np.promote_types(out.dtype, drawn_.dtype), copy=False)
        out[:, rep - reps.start] = drawn_
    return out


def segment_sums(w: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows `rows` of w over segments that begin at `starts` (the first at 0), the last to the end: whole numbers, added up as such."""
    out = np.zeros((len(starts), w.shape[1]))
    step = max(1, RUN_VALUES // (4 * w.shape[1]))
    for k in range(0, len(rows), step):
        e = min(len(rows), k + step)
        i, j = np.searchsorted(starts, k, "right") - 1, np.searchsorted(starts, e)
        out[i:j] += np.add.reduceat(w[rows[k:e]], np.maximum(starts[i:j] - k, 0), axis=0, dtype=np.uint32)
    return out


def score_blocks(cells: DataFrame, s: str) -> DataFrame:
    """label_index, part, seq, ranks, ys, ends: runs of about BLOCK cells of a label by falling score s; `ends` marks the last of equal scores, which stay in one run.

    Each cell (label_index, r, y and the score) is shuffled once, by ranges of label and score, so that a label may run over several of them.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label_index", F.desc(s)]
    rows = cells.select("label_index", "r", "y", s).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rest = TaskContext.get().partitionId(), 0, None
        for b in chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            if b is not None and t.num_rows < 2 * BLOCK:
                rest = t
                continue
            label, score, r, y = (t.column(c).to_numpy() for c in ("label_index", s, "r", "y"))
            fresh = np.flatnonzero((label[1:] != label[:-1]) | (score[1:] != score[:-1])) + 1  # where a step begins
            ends = np.zeros(len(r), bool)
            ends[fresh - 1] = ends[-1] = True
            starts = [0]
            for k in fresh.tolist():
                if k - starts[-1] >= BLOCK or label[k] != label[k - 1]:
                    starts.append(k)
            if b is None:
                starts.append(len(r))
            for a, e in zip(starts, starts[1:]):
                cols = [[int(label[a])], [part], [seq], [r[a:e].astype("<i8").tobytes()], [y[a:e].astype("u1").tobytes()], [ends[a:e].astype("u1").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["label_index", "part", "seq", "ranks", "ys", "ends"])
                seq += 1
            rest = t.slice(starts[-1]) if b is not None else None

    return written(rows.mapInArrow(cut, "label_index long, part int, seq int, ranks binary, ys binary, ends binary"))


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for r, y, e in zip(*(b.column(c).to_pylist() for c in ("ranks", "ys", "ends"))):
        yield np.frombuffer(r, "<i8"), np.frombuffer(y, "u1").astype(np.float64), np.flatnonzero(np.frombuffer(e, "u1"))


def _carries(blocks: DataFrame, w: Broadcast) -> DataFrame | None:
    """label_index, part, seq, before: draws of positives and of all in a label's earlier runs, reps of each; only where a label has several runs."""
    several = blocks.groupBy("label_index").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("label_index")
    if several.isEmpty():
        return None

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for r, y, _ in _read(b):
                p, n = (segment_sums(w.value, x, np.zeros(1, np.int64)).sum(axis=0) for x in (r[y > 0], r))
                sums.append(np.concatenate([p, n]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label_index", "part", "seq")), blocks_.arrays(np.array(sums).reshape(b.num_rows, -1))], ["label_index", "part", "seq", "v"])

    def running(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("seq", "ascending")]).combine_chunks()
        v = blocks_.matrix(t.column("v").combine_chunks())
        return pa.table([t.column("label_index"), t.column("part"), t.column("seq"), blocks_.arrays(np.cumsum(v, axis=0) - v)], ["label_index", "part", "seq", "before"])

    sums = blocks.join(several, "label_index", "left_semi").mapInArrow(totals, "label_index long, part int, seq int, v array<double>")
    return sums.groupBy("label_index").applyInArrow(running, "label_index long, part int, seq int, before array<double>")  # a row a run


def macro_auprc(blocks: DataFrame, w: Broadcast, name: str) -> DataFrame:
    """i (place of the rep), `name`: mean over labels with drawn positives of the average precision under each rep's weights, equal scores as one step.

    Runs stay where they are: the weights of their pairs, all reps side by side, are summed
    between the steps that have positives, for only these add to the area, and the sums
    run down. A row a run and then a row a label is shuffled, however many reps.
    """
    carries = _carries(blocks, w)
    rows = blocks.withColumn("before", F.lit(None).cast("array<double>")) if carries is None else blocks.join(carries, ["label_index", "part", "seq"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = w.value.shape[1]
        for b in batches:
            out = np.zeros((b.num_rows, 2 * reps))
            for i, ((r, y, ends), before) in enumerate(zip(_read(b), b.column("before").to_pylist())):
                carry = np.zeros(2 * reps) if before is None else np.array(before)
                hits = np.flatnonzero(y)
                if not len(hits):
                    continue
                last = ends[np.unique(np.searchsorted(ends, hits))]  # ends of the steps that have positives
                step = max(1, RUN_VALUES // (4 * reps))
                for k in range(0, len(last), step):
                    e = last[k : k + step] + 1
                    a, own = (last[k - 1] + 1 if k else 0), hits[np.searchsorted(hits, last[k - 1] + 1 if k else 0) : np.searchsorted(hits, e[-1])]
                    seen = segment_sums(w.value, r[a : e[-1]], np.concatenate([[0], e[:-1] - a]))
                    p = segment_sums(w.value, r[own], np.concatenate([[0], np.searchsorted(own, e[:-1])]))
                    tp, seen = np.cumsum(p, axis=0) + carry[:reps], np.cumsum(seen, axis=0) + carry[reps:]
                    out[i, :reps] += (p * tp / np.maximum(seen, 1)).sum(axis=0)
                    out[i, reps:] += p.sum(axis=0)
                    carry = np.concatenate([tp[-1], seen[-1]])
            yield pa.RecordBatch.from_arrays([b.column("label_index"), blocks_.arrays(out)], ["label_index", "v"])

    sums = blocks_.vector_sums(rows.mapInArrow(run, "label_index long, v array<double>"), "label_index")
    reps = w.value.shape[1]
    each = sums.select("v", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("i")).select("i", F.element_at("v", F.col("i") + 1).alias("s"), F.element_at("v", F.col("i") + (reps + 1)).alias("p"))
    return each.where("p > 0").groupBy("i").agg(F.avg(F.col("s") / F.col("p")).alias(name))


PARTS = ("P", "hit_a", "hit_b", "said_a", "said_b", "ap_a", "ap_b")


def _pair_sums(parts: DataFrame, w: Broadcast) -> DataFrame:
    """i, n and the sums of PARTS under each rep's weights: a block a task, merged in a tree."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((w.value.shape[1], len(PARTS) + 1))
        for b in batches:
            x = np.stack([np.ones(b.num_rows), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in PARTS)], axis=1)
            r = b.column("r").to_numpy()
            for k in range(0, len(r), 4096):
                total += w.value[r[k : k + 4096]].astype(np.float64).T @ x[k : k + 4096]
        yield pa.RecordBatch.from_arrays([blocks_.arrays(total.reshape(1, -1))], ["v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [blocks_.matrix(b.column("v")).sum(axis=0) for b in batches if b.num_rows]
        if rows:
            yield pa.RecordBatch.from_arrays([blocks_.arrays(np.sum(rows, axis=0)[None])], ["v"])

    k = len(PARTS) + 1
    one = blocks_.in_tree(parts.select("r", *PARTS).mapInArrow(inside, "v array<double>"), merge)
    each = one.select("v", F.explode(F.sequence(F.lit(0), F.lit(w.value.shape[1] - 1))).alias("i"))
    return each.select("i", *[F.element_at("v", F.col("i") * k + (j + 1)).alias(c) for j, c in enumerate(("n", *PARTS))])


def pair_rows(cells: DataFrame, threshold: float, k: int) -> DataFrame:
    """A row for each run of a pair's cells in a task: pair_id, PARTS, ys (its positive labels), key (the hash of its labels and scores), scores (these themselves, where a task meets the key first), odd.

    Odd are runs with nulls, scores that aren't numbers, truth that isn't 0 or 1, a label
    twice, and those of a key that a task can't hold beside ENTRIES labels of others.
    """
    fields = [*[T.StructField(c, T.LongType()) for c in PARTS[:5]], *[T.StructField(c, T.DoubleType()) for c in PARTS[5:]]]
    schema = T.StructType([cells.schema["pair_id"], *fields, *[T.StructField(c, t) for c, t in (("ys", T.ArrayType(T.LongType())), ("key", T.BinaryType()), ("scores", T.BinaryType()), ("odd", T.BooleanType()))]])
    most = ENTRIES

    def rows(t: pa.Table, starts: np.ndarray, met: set[bytes], held: list[int]) -> pa.RecordBatch:
        m, sizes = len(starts), np.diff(np.append(starts, t.num_rows))
        run = np.repeat(np.arange(m), sizes)
        ids = t.column("pair_id").combine_chunks().take(pa.array(starts))
        cell = np.empty(t.num_rows, [("label", "<i8"), ("a", "<f8"), ("b", "<f8")])
        odd = any(t.column(c).null_count for c in t.column_names)
        if not odd:
            cell["label"], y = t.column("label_index").to_numpy(), t.column("y").to_numpy()
            cell["a"], cell["b"] = t.column("a").to_numpy(), t.column("b").to_numpy()
            order = np.lexsort((cell["label"], run))
            cell, y, label = cell[order], y[order], cell["label"][order]
            odd = bool(np.isnan(cell["a"]).any() or np.isnan(cell["b"]).any() or ((y != 0) & (y != 1)).any() or ((label[1:] == label[:-1]) & (run[1:] == run[:-1])).any())
        if odd:
            return pa.RecordBatch.from_arrays([ids, *[pa.nulls(m, pa.int64())] * 5, *[pa.nulls(m, pa.float64())] * 2, pa.nulls(m, pa.list_(pa.int64())), *[pa.nulls(m, pa.binary())] * 2, pa.array(np.ones(m, bool))], schema.names)
        p = np.add.reduceat(y, starts).astype(np.int64)
        hit, said, ap = {}, {}, {}
        for s in "ab":
            over = cell[s] >= threshold
            hit[s], said[s] = np.add.reduceat(y * over, starts).astype(np.int64), np.add.reduceat(over, starts, dtype=np.int64)
            true = y[np.lexsort((-cell[s], run))]  # of equal scores the smaller label first
            tp, place = np.cumsum(true), np.arange(len(true)) - starts[run]
            tp = tp - (tp[starts] - true[starts])[run]
            ap[s] = np.add.reduceat(np.where((place < k) & (true == 1), tp / (place + 1), 0.0), starts) / np.maximum(np.minimum(p, k), 1)
        keys, scores, beyond, raw = [], [], np.zeros(m, bool), cell.tobytes()
        for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
            text = raw[start * cell.itemsize : (start + size) * cell.itemsize]
            keys.append(hashlib.md5(text).digest())
            fresh = keys[-1] not in met
            beyond[i] = fresh and held[0] + size > most
            scores.append(text if fresh and not beyond[i] else None)
            if scores[-1]:
                met.add(keys[-1])
                held[0] += size
        ys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32()), pa.array(label[y == 1]))
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, (p, hit["a"], hit["b"], said["a"], said["b"], ap["a"], ap["b"])), ys, pa.array(keys, pa.binary()), pa.array(scores, pa.binary()), pa.array(beyond)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, met, held = None, set(), [0]
        for b in chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            code = pc.fill_null(t.column("pair_id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            if b is None:
                yield rows(t.combine_chunks(), starts, met, held)
            else:  # the last run may go on
                rest = t.slice(starts[-1])
                if len(starts) > 1:
                    yield rows(t.slice(0, starts[-1]).combine_chunks(), starts[:-1], met, held)

    return cells.select("pair_id", F.col("label_index").cast("long"), F.col("y").cast("long"), F.col("a").cast("double"), F.col("b").cast("double")).mapInArrow(run, schema)


#: What a row of sums belongs to: the parts of all pairs, a kind, or a kind's positives of a label.
ALL, KIND, LABEL = 0, 1, 2


def _slices(placed: DataFrame, at: np.ndarray, reps: int, seed: int) -> DataFrame:
    """what, label, kind, v: sums under each rep's weights over slices of the pairs in the order of their places, in which a kind's pairs are neighbours.

    A task draws for a rep, and its weights go to the slices, packed: a byte a pair and rep
    before that. at: the rank of the pair at each place, which every task that draws holds.
    """
    spark, n = placed.sparkSession, len(at)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(SLICE, max(1, -(-n // (2 * parts))))
    sent = spark.sparkContext.broadcast(at)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep in b.column("id").to_pylist():
                w = drawn_of(n, rep, seed)[sent.value]
                w = w.astype(w.dtype.newbyteorder("<"))
                cuts = range(0, n, size)
                packed = [pa.compress(w[i : i + size].tobytes(), "zstd", asbytes=True) for i in cuts]
                cols = [pa.array(range(len(cuts)), pa.int32()), pa.array([rep] * len(cuts), pa.int32()), pa.array([w.itemsize] * len(cuts), pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["slice", "rep", "bytes", "w"])

    def add(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        rows, m = rows.sort_by("pos").combine_chunks(), rows.num_rows
        w = np.empty((reps, m), np.uint8 if pc.max(drawn.column("bytes")).as_py() == 1 else np.uint32)
        for rep, width, v in zip(*(drawn.column(c).to_pylist() for c in ("rep", "bytes", "w"))):
            w[rep] = np.frombuffer(pa.decompress(v, m * width, "zstd"), "u1" if width == 1 else "<u4")
        w = np.ascontiguousarray(w.T)
        x = np.stack([np.ones(m), *(rows.column(c).to_numpy().astype(np.float64) for c in PARTS)], axis=1)
        total = sum(w[i : i + 4096].astype(np.float64).T @ x[i : i + 4096] for i in range(0, m, 4096))
        kind, ys = rows.column("kind").to_numpy(), rows.column("ys").combine_chunks()
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        row, label = np.repeat(np.arange(m), pc.list_value_length(ys).to_numpy()), ys.flatten().to_numpy()
        order = np.lexsort((label, kind[row]))
        row, label = row[order], label[order]
        of = kind[row]
        each = np.flatnonzero(np.concatenate([[len(row) > 0], (of[1:] != of[:-1]) | (label[1:] != label[:-1])]))
        sums = [total.reshape(1, -1), segment_sums(w, np.arange(m), first), segment_sums(w, row, each) if len(each) else np.zeros((0, reps))]
        what = np.repeat(np.array([ALL, KIND, LABEL], np.int32), [1, len(first), len(each)])
        none = lambda k: np.zeros(k, np.int64)
        v = [r.tobytes() for part in sums for r in part.astype("<f8")]
        return pa.table([pa.array(what), pa.array(np.concatenate([none(1 + len(first)), label[each]])), pa.array(np.concatenate([none(1), kind[first], of[each]])), pa.array(v, pa.binary())], ["what", "label", "kind", "v"])

    weights = spark.range(0, reps, 1, min(reps, 4 * parts)).mapInArrow(draw, "slice int, rep int, bytes int, w binary")
    sides = placed.withColumn("slice", F.floor(F.col("pos") / size).cast("int")).groupBy("slice").cogroup(weights.groupBy("slice"))
    return written(sides.applyInArrow(add, "what int, label long, kind long, v binary"))


def _by_kinds(rows: DataFrame, kinds: pa.Table, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (reps x parts, their number first) over pairs, and (reps x 2) macro AUPRC of both scorers, not a number where no label has drawn positives.

    Pairs of one kind have the same labels and scores, hence the same place in each label's
    order: weights are summed once by kind, and those of positives by kind and label. What
    runs down the scores are kinds then, however many pairs there are.
    """
    spark = rows.sparkSession
    keys = kinds.column("key").to_pylist()
    number = spark.createDataFrame(list(zip(map(bytearray, keys), range(len(keys)))), "key binary, kind long")
    ranks = dense_id(rows.select("pair_id"), ["pair_id"], "r")
    known = rows.join(F.broadcast(number), "key").select("pair_id", "kind", *PARTS, "ys").join(ranks, "pair_id").drop("pair_id")  # ENTRIES kinds at most
    placed = written(dense_id(known, ["kind", "r"], "pos"))
    found = placed.select("pos", F.col("r").cast("int")).toArrow()
    at = np.empty(found.num_rows, np.int32)
    at[found.column("pos").to_numpy()] = found.column("r").to_numpy()
    sums = _slices(placed, at, reps, seed)
    total, seen = np.zeros((reps, len(PARTS) + 1)), np.zeros((len(keys), reps))
    for b in sums.where(F.col("what") != LABEL).toArrow().to_batches():
        for what, kind, v in zip(*(b.column(c).to_pylist() for c in ("what", "kind", "v"))):
            if what == ALL:
                total += np.frombuffer(v, "<f8").reshape(total.shape)
            else:
                seen[kind] += np.frombuffer(v, "<f8")
    cell = np.concatenate([np.frombuffer(x, [("label", "<i8"), ("a", "<f8"), ("b", "<f8")]) for x in kinds.column("scores").to_pylist()])
    of = np.repeat(np.arange(len(keys)), [len(x) // cell.itemsize for x in kinds.column("scores").to_pylist()])
    order = np.argsort(cell["label"], kind="stable")
    sent = spark.sparkContext.broadcast((seen, cell[order], of[order]))

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        seen, cell, of = sent.value
        label = key[0].as_py()
        i, e = np.searchsorted(cell["label"], [label, label + 1])
        own, kind = cell[i:e], of[i:e]  # kinds in their order
        p = np.zeros((len(kind), reps))
        for k, v in zip(np.searchsorted(kind, t.column("kind").to_numpy()).tolist(), t.column("v").to_pylist()):
            p[k] += np.frombuffer(v, "<f8")
        drawn, out = p.sum(axis=0), {}
        for s in "ab":
            down = np.argsort(-own[s], kind="stable")
            ends = np.flatnonzero(np.append(own[s][down][1:] != own[s][down][:-1], True))
            out[s] = np.zeros(reps)
            step = max(1, RUN_VALUES // len(kind))
            for c in range(0, reps, step):
                tp, n = (np.cumsum(x[:, c : c + step], axis=0)[ends] for x in (p[down], seen[kind[down]]))
                out[s][c : c + step] = (np.diff(tp, axis=0, prepend=0) * tp / np.maximum(n, 1)).sum(axis=0)
        rep = np.flatnonzero(drawn)
        return pa.table([pa.array(rep.astype(np.int32)), *(pa.array(out[s][rep] / drawn[rep]) for s in "ab")], ["rep", "a", "b"])

    each = sums.where(F.col("what") == LABEL).groupBy("label").applyInArrow(judge, "rep int, a double, b double")  # ENTRIES rows at most, and a row a label and slice
    macro = np.full((reps, 2), np.nan)
    for r in each.groupBy("rep").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).collect():
        macro[r["rep"]] = r["a"], r["b"]
    sent.unpersist()
    return total, macro


def _kinds(cells: DataFrame, threshold: float, k: int) -> tuple[DataFrame, pa.Table] | None:
    """A row a pair and the kinds (key, scores) of all, or None if a pair is odd or kinds have more than ENTRIES labels. Cells are shuffled only if those of a pair don't come together."""
    rows = written(pair_rows(cells, threshold, k))
    n = rows.agg(F.count(F.lit(1)).alias("c"), F.countDistinct("pair_id").alias("n")).first()
    if n["n"] < n["c"]:
        rows = written(pair_rows(cells.repartition("pair_id").sortWithinPartitions("pair_id"), threshold, k))
    if not rows.where("odd").isEmpty():
        return None
    kinds = rows.where("scores IS NOT NULL").select("key", "scores").dropDuplicates(["key"])
    if (kinds.agg(F.sum(F.length("scores"))).first()[0] or 0) > 24 * ENTRIES:
        return None
    return rows.drop("scores", "odd"), kinds.toArrow().sort_by("key")


def _by_labels(cells: DataFrame, reps: int, threshold: float, k: int, seed: int) -> DataFrame:
    """What paired() gives, for any scores: each label's scores are sorted once.

    The weights of as many reps as WEIGHT_BYTES hold are broadcast at a time (of one rep at
    least, a byte a pair). No rows shuffled depend on the number of reps. No cells: no rows.
    """
    spark = cells.sparkSession
    schema = "rep long, metric string, a double, b double, diff double"
    ranks = written(dense_id(cells.select("pair_id").distinct(), ["pair_id"], "r"))
    n = ranks.count()
    if not n:
        return spark.createDataFrame([], schema)
    cells = written(cells.join(ranks, "pair_id"))
    parts = written(_pair_parts(cells, threshold, k).join(ranks, "pair_id"))
    blocks = {s: score_blocks(cells, s) for s in "ab"}
    f1 = lambda s: F.when(F.col(f"said_{s}") + F.col("P") > 0, 2 * F.col(f"hit_{s}") / (F.col(f"said_{s}") + F.col("P"))).otherwise(0.0)
    row = lambda name, a, b: F.struct(F.lit(name).alias("metric"), a.alias("a"), b.alias("b"), (a - b).alias("diff"))
    out, step = [], max(1, WEIGHT_BYTES // n)
    for first in range(0, reps, step):
        w = spark.sparkContext.broadcast(weight_block(spark, n, range(first, min(reps, first + step)), seed))
        sums = _pair_sums(parts, w).join(macro_auprc(blocks["a"], w, "m_a"), "i", "left").join(macro_auprc(blocks["b"], w, "m_b"), "i", "left")
        rows = F.array(row("micro_f1", f1("a"), f1("b")), row("ap_at_k", F.col("ap_a") / F.col("n"), F.col("ap_b") / F.col("n")), row("macro_auprc", F.col("m_a"), F.col("m_b")))
        out.append(written(sums.select((F.col("i") + first).alias("rep").cast("long"), F.inline(rows)).where("a IS NOT NULL")))
        w.unpersist()
    return reduce(DataFrame.unionByName, out)


def paired(cells: DataFrame, reps: int = 500, threshold: float = 0.5, k: int = 50, seed: int = 13) -> DataFrame:
    """rep, metric, a, b, diff: micro_f1, ap_at_k and macro_auprc of both scorers on the same draws, thresholds fixed.

    F1 and AP@k are sums over pairs. Where scores are shared by many pairs, these are
    summed by kind (_by_kinds), else each label's scores are sorted once (_by_labels).
    No cells: no rows.
    """
    spark, schema = cells.sparkSession, "rep long, metric string, a double, b double, diff double"
    found = _kinds(cells, threshold, k)
    if found is None:
        return _by_labels(cells, reps, threshold, k, seed)
    if not found[1].num_rows:
        return spark.createDataFrame([], schema)
    total, macro = _by_kinds(*found, reps, seed)
    n, p, hit_a, hit_b, said_a, said_b, ap_a, ap_b = total.T
    f1 = lambda hit, said: 2 * hit / np.maximum(said + p, 1)
    each = {"micro_f1": (f1(hit_a, said_a), f1(hit_b, said_b)), "ap_at_k": (ap_a / n, ap_b / n), "macro_auprc": macro.T}
    rows = [(rep, m, float(a[rep]), float(b[rep]), float(a[rep] - b[rep])) for m, (a, b) in each.items() for rep in range(reps) if not np.isnan(a[rep])]
    return spark.createDataFrame(rows, schema)


def summary(reps: DataFrame) -> DataFrame:
    """Per metric: mean difference, its 95 % interval, signs, and (k + 1) / (B + 1) with k the reps where a isn't ahead."""
    d = F.round("diff", 9)
    k, n = F.count_if(d <= 0), F.count(F.lit(1))
    return reps.groupBy("metric").agg(
        *[(F.round(f, 6) + 0.0).alias(c) for c, f in (("mean", F.avg("diff")), ("low", F.percentile("diff", F.lit(0.025))), ("high", F.percentile("diff", F.lit(0.975))))],  # no -0.0
        F.count_if(d > 0).alias("a_ahead"), F.count_if(d < 0).alias("b_ahead"), F.round((k + 1) / (n + 1), 6).alias("p"),
    )
