"""Losses, weights and probabilities as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cross_entropy(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow for large ones."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal(x: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, smoothing: float = 0.0) -> Column:
    """Focal loss of a logit; a negative alpha turns the class weight off, smoothing draws targets towards a half."""
    if not 0 <= smoothing < 1:
        raise ValueError(f"smoothing must be in [0, 1), got {smoothing}")
    y = y.cast("double") * (1 - smoothing) + smoothing / 2
    p = sigmoid(x)
    loss = cross_entropy(x, y) * F.pow(1 - (p * y + (1 - p) * (1 - y)), F.lit(float(gamma)))
    return loss if alpha < 0 else loss * (alpha * y + (1 - alpha) * (1 - y))


def decay(step: Column, first: float, steps: float, rate: float, staircase: bool = True) -> Column:
    """first * rate ** (step / steps), the exponent rounded down for a staircase. A negative step raises an error in the job."""
    if steps <= 0:
        raise ValueError(f"steps must be positive, got {steps}")
    power = step / steps
    checked = F.when(step < 0, F.raise_error(F.lit("a step is negative")).cast("double")).otherwise(F.floor(power).cast("double") if staircase else power)
    return first * F.pow(F.lit(float(rate)), checked)


def log_sum_exp(xs: Column) -> Column:
    """Of an array of logits; null where it is empty."""
    top = F.array_max(xs)
    return F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top


def yes_share(yes: Column, no: Column) -> Column:
    """Softmax share of the first of two groups of logits."""
    return sigmoid(log_sum_exp(yes) - log_sum_exp(no))


def mean_losses(rows: DataFrame) -> DataFrame:
    """weighted, of_batches: mean loss over all rows (batch, loss), and the mean of the batches' means, which differ where batches do in size."""
    b = rows.groupBy("batch").agg(F.avg("loss").alias("l"), F.count("loss").alias("n"))
    return b.agg(F.round(F.sum(F.col("l") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.round(F.avg("l"), 6).alias("of_batches"))
