"""Metric histories (run, epoch, metric): patience rule and best rows. A run's history is one row an epoch."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patience(history: DataFrame, misses: int = 10, min_delta: float = 0.0) -> DataFrame:
    """run, best_epoch, best, stop_epoch: an epoch is better if it exceeds the best by more than min_delta; `misses` epochs in a row that aren't stop the run.

    A running maximum is no substitute: with min_delta above 0 the best depends on the
    path. stop_epoch is null where the run ends first. Null metrics are misses.
    """
    steps = F.sort_array(F.collect_list(F.struct("epoch", "metric")))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("missed"), F.lit(None).cast("long").alias("stop"))

    def step(s, x):
        better = x["metric"].isNotNull() & (s["best"].isNull() | (x["metric"] > s["best"] + min_delta))
        missed = F.when(better, 0).otherwise(s["missed"] + 1)
        moved = F.struct(
            F.when(better, x["metric"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"].cast("long")).otherwise(s["at"]).alias("at"),
            missed.alias("missed"), F.when(missed >= misses, x["epoch"].cast("long")).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    told = history.groupBy("run").agg(F.aggregate(steps, start, step).alias("s"))
    return told.select("run", F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best"), F.col("s.stop").alias("stop_epoch"))


def extremes(history: DataFrame) -> DataFrame:
    """run, best_epoch, worst_epoch, last_epoch by the metric; the first of equals."""
    return history.groupBy("run").agg(
        F.max_by("epoch", F.struct("metric", -F.col("epoch"))).cast("long").alias("best_epoch"),
        F.min_by("epoch", F.struct("metric", "epoch")).cast("long").alias("worst_epoch"),
        F.max("epoch").cast("long").alias("last_epoch"),
    )


def rounded(rows: DataFrame, metrics: list[str], rate: str | None = None) -> DataFrame:
    """History rows with metrics to 6 decimals and the learning rate to 8."""
    digits = {**{m: 6 for m in metrics}, **({rate: 8} if rate else {})}
    return rows.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in rows.columns])


def sweep(runs: DataFrame, metric: str) -> DataFrame:
    """One row over runs of several seeds: how many, mean, population deviation, least and most."""
    return runs.agg(F.count(metric).alias("n_runs"), *[F.round(f(metric), 6).alias(k) for k, f in {"mean": F.avg, "std": F.stddev_pop, "least": F.min, "most": F.max}.items()])


def z_scores(values: DataFrame, targets: DataFrame) -> DataFrame:
    """metric, value, z: distance to the target's mean in its deviations; null without a target or with a deviation of 0."""
    return values.join(targets.select("metric", F.col("mean").alias("_m"), F.col("std").alias("_s")), "metric", "left").select("metric", "value", F.round((F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0)), 6).alias("z"))


def verdict(z, near: float = 1.0, far: float = 2.0):
    """'matches' within `near` deviations, 'close' within `far`, else 'differs'; 'undefined' for null."""
    return F.when(z.isNull(), "undefined").when(F.abs(z) <= near, "matches").when(F.abs(z) <= far, "close").otherwise("differs")


def beside_training(metrics: DataFrame, history: DataFrame) -> DataFrame:
    """Rows (run, epoch, ...) of many scorers on the same edges beside the training history of their epoch, which may lack some."""
    return metrics.join(history, ["run", "epoch"], "left")
