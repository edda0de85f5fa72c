"""Two scorers over the same cells (pair_id, label_index, y, a, b)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def winner(a, b, tolerance: float = 1e-12):
    return F.when(a - b > tolerance, "a").when(a - b < -tolerance, "b").otherwise("tie")


def agreement(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Decisions of both at a threshold: counts and the share that agree."""
    a, b = F.col("a") >= threshold, F.col("b") >= threshold
    return cells.agg(
        F.count_if(a & b).alias("both_pos"), F.count_if(~a & ~b).alias("both_neg"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"),
        F.round(100 * F.avg((a == b).cast("int")), 4).alias("agree_pct"),
    )


def pearson(cells: DataFrame) -> DataFrame:
    return cells.agg(F.round(F.corr("a", "b"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


def first_of_pairs(cells: DataFrame, k: int) -> DataFrame:
    """pair_id, label_index, a, b without the cells that have, for either scorer, k cells of their pair before them in their batch: at most 2 * k a pair and batch reach a shuffle."""
    names = ["pair_id", "label_index", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pair, label = (b.column(c).to_numpy(zero_copy_only=False) for c in names[:2])
            keep = np.zeros(len(pair), bool)
            for c in "ab":
                null = b.column(c).is_null().to_numpy(zero_copy_only=False)
                score = np.where(null, np.nan, b.column(c).to_numpy(zero_copy_only=False).astype(np.float64))
                # Spark's falling order: not a number, numbers, null
                kind = np.where(null, 2, np.where(np.isnan(score), 0, 1))
                order = np.lexsort((label, -np.where(kind == 1, score, 0.0), kind, pair))
                start = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))
                place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
                keep[order[place < k]] = True
            yield b.filter(pa.array(keep))

    kinds = {"pair_id": "long", "label_index": "long", "a": "double", "b": "double"}
    return cells.select(*[F.col(c).cast(t) for c, t in kinds.items()]).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def jaccard(cells: DataFrame, k: int = 10) -> DataFrame:
    """Overlap of a pair's first k labels of both scorers: mean, median, population deviation, extremes; an empty union is 1."""
    rank = lambda c: F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(c), "label_index"))
    r = first_of_pairs(cells, k).withColumns({"ra": rank("a"), "rb": rank("b")})
    a, b = F.col("ra") <= k, F.col("rb") <= k
    per = r.groupBy("pair_id").agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"))
    j = F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(1.0)
    return per.agg(F.round(F.avg(j), 6).alias("mean"), F.round(F.percentile(j, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop(j), 6).alias("std"), F.round(F.min(j), 6).alias("least"), F.round(F.max(j), 6).alias("most"))


def label_wins(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, winner, n over two per-label tables; undefined values take no part."""
    long = lambda d, v: d.unpivot(["label_index"], ["auroc", "auprc", "f1"], "metric", v)
    both = long(a, "va").join(long(b, "vb"), ["label_index", "metric"]).where("va IS NOT NULL AND vb IS NOT NULL")
    return both.groupBy("metric", winner(F.col("va"), F.col("vb")).alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def label_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_index and, for auroc, auprc and f1, the values of both, their difference and winner (null where one is undefined). Each label of `a` must be in `b` once."""
    from .checks import whole_join

    names = ["auroc", "auprc", "f1"]
    both = whole_join(a.select("label_index", *[F.col(m).alias(f"a_{m}") for m in names]), b.select("label_index", *[F.col(m).alias(f"b_{m}") for m in names]), ["label_index"])
    for m in names:
        x, y = F.col(f"a_{m}"), F.col(f"b_{m}")
        both = both.withColumn(f"{m}_diff", F.round(x - y, 6) + 0.0).withColumn(f"{m}_winner", F.when((x - y).isNotNull(), winner(x, y)))
    return both


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text: each part's rows as a list, in the order of their JSON. Parts are reports of a few rows."""
    lists = [d.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}))).alias(k)) for k, d in parts.items()]
    one = lists[0]
    for d in lists[1:]:
        one = one.crossJoin(d)  # one row each
    return one.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":['), F.array_join(k, ","), F.lit("]")) for k in parts]), F.lit("}")).alias("document"))


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows (id, name, p) of two name sources, how many names differ, and how the scores do: mean change, flipped at 0.5, changed by more than 0.1."""
    both = before.select("id", F.col("name").alias("n0"), F.col("p").alias("p0")).join(after.select("id", F.col("name").alias("n1"), F.col("p").alias("p1")), "id")
    d = F.abs(F.col("p0") - F.col("p1"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("n0").eqNullSafe(F.col("n1"))).alias("renamed"), F.round(F.avg(d), 6).alias("mean_change"),
        F.count_if((F.col("p0") >= 0.5) != (F.col("p1") >= 0.5)).alias("flipped"), F.count_if(d > 0.1).alias("changed"),
    )
