"""Checks as tables (check, n_bad): columns, keys, configurations, widths; `enforce` turns any of them into an error."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check of `enforce` found something."""


def enforce(checks: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """Raises CheckFailed with the names and counts of the checks that found something, else returns `df` (or the checks). Checks are a few rows."""
    bad = {r["check"]: r["n_bad"] for r in checks.where("n_bad > 0").collect()}
    if bad:
        raise CheckFailed(", ".join(f"{k}: {n}" for k, n in sorted(bad.items())))
    return checks if df is None else df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, if it has the columns; the error names those required, found and missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckFailed(f"required {columns}, found {df.columns}, missing {missing}")
    return df


def counted(**frames: DataFrame) -> DataFrame:
    """check, n_bad: the number of rows of each frame."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(k).alias("check"), "n_bad") for k, d in frames.items()])


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """check, n_bad: keys of one table alone, repeats counting."""
    return counted(first_only=a.select(keys).exceptAll(b.select(keys)), second_only=b.select(keys).exceptAll(a.select(keys)))


def comparable(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """field, a, b, same: listed fields of two configurations, a row each (null equals null)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select([F.col(c).cast("string").alias(c) for c in fields]).unpivot([], fields, "field", name)

    return long(a, "a").join(long(b, "b"), "field", "full_outer").withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def widths(weights: DataFrame, n_features: int, n_labels: int) -> DataFrame:
    """check, n_bad: weights (label_index, w) of another width than the features, labels without any, labels that aren't there."""
    labels = weights.sparkSession.range(n_labels).select(F.col("id").alias("label_index"))
    return counted(
        width=weights.where(F.coalesce(F.size("w") != n_features, F.lit(True))),
        no_weights=labels.join(weights, "label_index", "left_anti"),
        alien=weights.join(labels, "label_index", "left_anti"),
    )


def whole_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that must keep each row of the left side once, else CheckFailed."""
    n = right.groupBy(keys).agg(F.count(F.lit(1)).alias("_n"))
    off = left.join(n, keys, "left").agg(F.count_if(F.col("_n").isNull()).alias("lost"), F.count_if(F.col("_n") > 1).alias("multiplied"))
    enforce(off.unpivot([], ["lost", "multiplied"], "check", "n_bad"))
    return left.join(right, keys)


def leakage(**shared: tuple[DataFrame, DataFrame, list[str]]) -> DataFrame:
    """check, n_bad: for each named (held, seen, keys) how many distinct keys of `held` are in `seen`."""
    return counted(**{k: held.select(keys).distinct().join(seen.select(keys), keys, "left_semi") for k, (held, seen, keys) in shared.items()})
