"""Helpers shared by the corpus operators: tables, shared folders, joins with hot keys."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of a slice's texts stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row a key, whose column `count` says how many of the `total` rows have it.

    Keys of more than a share of the rows are few, at most 4 x partitions, and are
    broadcast, so that their rows stay where they are; the others are joined by key.
    """
    limit = max(1, total // (4 * partitions(rows.sparkSession)))
    hot = F.broadcast(values.where(F.col(count) > limit).drop(count))
    cold = values.where(F.col(count) <= limit).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))
