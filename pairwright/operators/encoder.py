"""Vectors of texts and their audits: pooling under a mask, token lengths, diagnostics of a vector table, histograms."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import unit_gram, vector_sums
from ..functions.shared import dense_id
from .vectors import norm


def mean_pooled(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, dim, value: mean of the vectors (token, v) of a key's tokens (key, token, mask) with mask 1, over at least 1; tokens without a vector count as zeros.

    A vector stays one row until it is summed, in tasks first. A key without tokens gives no row.
    """
    n = tokens.groupBy("key").agg(F.sum("mask").alias("n"))
    weighted = tokens.where("mask = 1").groupBy("key", "token").agg(F.count(F.lit(1)).alias("k")).join(vectors, "token")
    mean = F.transform("v", lambda x: x / F.greatest("n", F.lit(1)))
    return vector_sums(weighted, "key", weight="k").join(n, "key").select("key", F.posexplode(mean).alias("dim", "value"))


def token_audit(texts: DataFrame, limit: int = 64) -> DataFrame:
    """One row: least, median, mean and most words of a text, and how many texts exceed the limit, in all and in percent. Counts meet before the median."""
    counts = texts.where("text IS NOT NULL").groupBy(F.size(F.split("text", r"\s+")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    over, all_ = F.sum(F.when(F.col("w") > limit, F.col("n")).otherwise(0)), F.sum("n")
    return counts.agg(
        F.min("w").alias("least"), F.expr("percentile(w, 0.5D, n)").alias("median"), F.round(F.sum(F.col("w") * F.col("n")) / all_, 4).alias("mean"), F.max("w").alias("most"),
        over.alias("n_over"), F.round(100 * over / all_, 2).alias("over_pct"),
    )


def over_limit(texts: DataFrame, key: str, limit: int = 64) -> DataFrame:
    """key, n_words of the texts of more words than the limit."""
    n = F.size(F.split("text", r"\s+"))
    return texts.where("text IS NOT NULL").select(key, n.cast("long").alias("n_words")).where(F.col("n_words") > limit)


def text_index(texts: DataFrame, key: str, limit: int = 64) -> DataFrame:
    """place, key, hash, n_words, truncated: one row a text, its place from 0 in the order of the keys, its SHA-256, its words and whether they exceed the limit; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.split(text, r"\s+")).cast("long")
    rows = texts.select(key, F.sha2(text, 256).alias("hash"), n.alias("n_words"), (n > limit).alias("truncated"))
    return dense_id(rows, [key], "place")


def diagnostics(vectors: DataFrame) -> DataFrame:
    """One row: mean and deviation of norms, mean and deviation of the cosines of all pairs, groups of equal vectors, zero vectors.

    The sums over all pairs of unit vectors come from the sum of the vectors and their
    Gram matrix, a block a task that meets the others in a tree, so no pair is formed.
    Equal vectors meet by two hashes.
    """
    rows = vectors.select("v", norm(F.col("v")).alias("r"))
    plain = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.count_if(F.col("r") == 0).alias("zero"))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    sums = unit_gram(vectors).select(squares("total").alias("t1"), squares("gram").alias("t2"), "q1", "q2")
    groups = vectors.groupBy(F.xxhash64("v"), F.xxhash64(F.lit(7), "v")).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("t1") - F.col("q1")) / pairs
    every = plain.join(F.broadcast(sums)).join(F.broadcast(groups))  # one row each
    return every.select(
        F.round("m", 6).alias("norm_mean"), F.round("s", 6).alias("norm_std"), F.round(mean, 6).alias("cosine_mean"),
        F.round(F.sqrt(F.greatest((F.col("t2") - F.col("q2")) / pairs - mean * mean, F.lit(0.0))), 6).alias("cosine_std"), F.col("repeated").alias("repeated_groups"), F.col("zero").alias("zero_vectors"),
    )


def histogram(vectors: DataFrame, decimals: int = 1) -> DataFrame:
    """value, n: how often each rounded cell value occurs."""
    cells = vectors.select(F.explode("v").alias("x")).where("x IS NOT NULL")
    return cells.groupBy((F.round(F.col("x").cast("double"), decimals) + 0.0).alias("value")).agg(F.count(F.lit(1)).alias("n"))
