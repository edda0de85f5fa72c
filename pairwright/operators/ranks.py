"""Ranks over whole tables without a single-task window, and what is told from them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import before, keys_at
from ..functions.shared import dense_id, hash32, prefix_sums


def average_ranks(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """Distinct values with their counts `n` get the mean of the ranks (from 1) that their rows hold."""
    run = prefix_sums(counts.groupBy(value).agg(F.sum(n).alias("_n")), [value], {"_seen": "_n"})
    return run.select(value, (F.col("_seen") - (F.col("_n") - 1) / 2).alias(name))


def spearman(cells: DataFrame, n: int = 100_000, seed: int = 23) -> DataFrame:
    """Rank correlation of a and b over n cells drawn by hash, with n and the t statistic; null where either is constant.

    Equal (a, b) collapse first, so that ties cost no rows in the joins with the ranks.
    """
    h = hash32(F.concat_ws("-", "pair_id", "label_index"), seed)
    keyed, by = cells.withColumn("_h", h), ["_h", "pair_id", "label_index"]
    (end,) = keys_at(keyed, by, lambda _: [n])
    both = keyed.where(before(by, end)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    ranked = both.join(average_ranks(both, "a", "w", "ra"), "a").join(average_ranks(both, "b", "w", "rb"), "b")
    total = both.agg(F.sum("w").alias("n"))
    x, y, w = (F.col("ra") - (F.col("n") + 1) / 2), (F.col("rb") - (F.col("n") + 1) / 2), F.col("w")
    sums = ranked.join(F.broadcast(total)).agg(  # one row on the right
        F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum("w").alias("n")
    )
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    t = F.when((F.abs(r) < 1) & (F.col("n") > 2), r * F.sqrt((F.col("n") - 2) / (1 - r * r)))
    return sums.select(F.round(r, 6).alias("spearman"), F.round(t, 2).alias("t"), "n")


def rank_differences(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """n, n_different: rows whose places by two measures (largest first, ties by key) differ."""
    first = dense_id(df.select(key, a, b), [F.desc(a), key], "_ra")
    both = dense_id(first, [F.desc(b), key], "_rb")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_ra") != F.col("_rb")).alias("n_different"))


def evenly_spaced(df: DataFrame, key: str, k: int) -> DataFrame:
    """At most k rows, spread evenly over the order of the key, first and last included."""
    ranked = dense_id(df, [key], "_r")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    step = F.floor(F.col("id") * (F.col("_n") - 1) / max(1, k - 1))
    places = df.sparkSession.range(k).join(F.broadcast(n)).select(step.alias("_r")).distinct()
    return ranked.join(F.broadcast(places), "_r", "left_semi").drop("_r")  # k rows on the right
