"""Numbering, hashing and materialising without a single-task window."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if found is None and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Frames that this process has written, by application.
_FRAMES: dict[str, list[str]] = {}


def frame_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    path = os.path.join(shared_dir(spark), f"frame-{uuid.uuid4().hex}")
    _FRAMES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_frames(spark: SparkSession) -> int:
    """Deletes the frames that this session has written so far and says how many; results that still read them can't be used after it."""
    paths = _FRAMES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there."""
    path = frame_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash32(key: Column, seed: int) -> Column:
    """First 8 hex digits of md5(key:seed) as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def _placed(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """Rows in ranges of the order, each with the number of its range and its place there."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(rows.withColumn("_m", m).withColumn("_part", F.shiftright("_m", 33)).withColumn("_place", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"))


def dense_id(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a number from 0 without gaps in sort order. Counts of the ranges, a row each, give the offsets."""
    rows = _placed(df, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def dense_groups(df: DataFrame, keys: list[str], name: str, first: str) -> DataFrame:
    """Adds to each row the number of its group, equal keys, from 0 without gaps in sort order, and whether it is the first row of it.

    One sort by the keys; a group isn't reduced to a row and joined again to its rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    own = {"_part": T.IntegerType(), "_place": T.LongType(), first: T.BooleanType()}
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, t) for c, t in own.items()]])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            now, new = [b.column(c) for c in keys], np.zeros(b.num_rows, bool)
            for v in now:
                x, y = v[1:], v[:-1]
                differs = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(x.is_null(), y.is_null()))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            new[0] = last != [v[0].as_py() for v in now]
            place = seen - 1 + np.cumsum(new)
            seen, last = int(place[-1]) + 1, [v[-1].as_py() for v in now]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(place), pa.array(new)], schema.names)

    placed = written(rows.mapInArrow(number, schema))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.where(first).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def running_sums(df: DataFrame, group: str, order: str, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds running sums (result: column) within each group, by falling `order`, the row itself included.

    One sort by (group, order) in `parts` ranges, as many as a shuffle has if not given; a large group runs over several of them. Only
    the first group of a range can have begun before it, so that what is carried over,
    and broadcast, is at most a row a range.
    """
    rows = _placed(df, [group, F.desc(order)], parts)
    totals = rows.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_s_{r}") for r, c in sums.items()])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(group, "_part", *[F.sum(f"_s_{r}").over(earlier).alias(f"_b_{r}") for r in sums], F.lag(F.lit(True)).over(Window.partitionBy(group).orderBy("_part")).alias("_on")).where("_on").drop("_on")
    inner = Window.partitionBy(group, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({r: F.sum(c).over(inner) for r, c in sums.items()}).join(F.broadcast(carried), [group, "_part"], "left")
    return out.withColumns({r: F.col(r) + F.coalesce(F.col(f"_b_{r}"), F.lit(0)) for r in sums}).drop("_part", "_place", *[f"_b_{r}" for r in sums])


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds running sums (result: column) in sort order, the row itself included, over all rows."""
    rows = _placed(df, order)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{r}") for r, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_s_{r}").over(before), F.lit(0)).alias(f"_b_{r}") for r in sums])
    inner = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "_part")
    for r, c in sums.items():
        out = out.withColumn(r, F.sum(c).over(inner) + F.col(f"_b_{r}"))
    return out.drop("_part", "_place", *[f"_b_{r}" for r in sums])
