"""Profiles and audits of tables: one pass each, all as rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a name as a registry number or a systematic name.
REJECTED = [
    r"^\d+-\d+-\d+$",
    r"(?i)^DB\d+$",
    r"(?i)^CHEBI[:\-]?\d+$",
    r"(?i)^CHEMBL\d+$",
    r"(?i)^UNII[- ]?[A-Z0-9]+$",
    r"(?i)^NSC[- ]?\d+$",
    r"(?i)^EINECS",
    r"^\d+$",
    r"[\[\]{}]",
    r"\d.*-.*\d",
]


def profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null, null_pct, n_distinct of every column; values are counted before they meet. An empty table gives no rows."""
    values = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], [f"`{c}`" for c in df.columns], "column", "value")
    counts = values.groupBy(F.regexp_replace("column", "`", "").alias("column"), "value").agg(F.count(F.lit(1)).alias("n"))
    null = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    return counts.groupBy("column").agg(F.sum("n").alias("n_rows"), null.alias("n_null"), F.round(100 * null / F.sum("n"), 2).alias("null_pct"), F.count("value").alias("n_distinct"))


def whole_profile(df: DataFrame, order: str) -> DataFrame:
    """column, type, n_rows, n_null, null_pct, n_distinct, first (the value as text in the row of the smallest `order`) of every column. An empty table gives no rows."""
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    first = df.agg(F.min_by(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), order).alias("r"))
    long = first.select("r.*").unpivot([], [f"`{c}`" for c in df.columns], "column", "first").withColumn("column", F.regexp_replace("column", "`", ""))
    return profile(df).join(F.broadcast(kinds), "column").join(F.broadcast(long), "column").select("column", "type", "n_rows", "n_null", "null_pct", "n_distinct", "first")  # a row a column on the right


def rows_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys, and the least, median, mean and most rows of one."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return n.agg(F.count(F.lit(1)).alias("n_keys"), F.min("k").alias("least"), F.percentile("k", F.lit(0.5)).alias("median"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("most"))


def id_profile(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: missing, matching, malformed and distinct ids, and the range of the number in the pattern's first group."""
    c = F.col(column)
    missing = F.trim(F.coalesce(c, F.lit(""))) == ""
    number = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("long")
    matched = F.coalesce(c.rlike(pattern), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_missing"), F.count_if(matched).alias("n_matched"), F.count_if(~missing & ~matched).alias("n_malformed"),
        F.countDistinct(c).alias("n_distinct"), F.min(number).alias("least"), F.max(number).alias("most"),
    )


def id_examples(df: DataFrame, column: str, pattern: str, most: int = 10) -> DataFrame:
    """kind (missing, malformed, duplicate), value, n: the first `most` values of each kind with their rows, by value. Null counts as ''."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.trim("value") == ""
    kinds = F.array(F.when(blank, "missing"), F.when(~blank & ~F.col("value").rlike(pattern), "malformed"), F.when(~blank & (F.col("n") > 1), "duplicate"))
    long = counts.select(F.explode(F.array_compact(kinds)).alias("kind"), "value", "n")
    return long.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).where(F.col("_r") <= most).drop("_r")


def aligned(a: DataFrame, b: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """check, n_bad: keys in one table alone, and keys in both whose rows differ (null equals null, order doesn't count, repeats do).

    Rows of a key collapse to how many there are and a sum of their digests before the
    tables meet, so a hot or null key is a row of either.
    """
    def folded(df: DataFrame, name: str) -> DataFrame:
        digest = F.xxhash64(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in attributes]), {"ignoreNullFields": "false"}))
        return df.groupBy(F.struct(F.col(key).alias("k")).alias("key")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(digest, 24)).alias("d")).alias(name))

    both = folded(a, "_a").join(folded(b, "_b"), "key", "full_outer")
    s = both.agg(
        F.count_if(F.col("_b").isNull()).alias("first_only"), F.count_if(F.col("_a").isNull()).alias("second_only"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("different"),
    )
    return s.unpivot([], s.columns, "check", "n_bad")


def link_contract(links: DataFrame, positives: DataFrame, low: float = 0.05, high: float = 0.15) -> DataFrame:
    """check, n_bad: shares of val and test outside (low, high), edges of several roles, edges not in the graph, edges without a role."""
    keys = ["pair_id", "label_index"]
    share = lambda r: F.avg((F.col("role") == r).cast("int"))
    outside = lambda r: F.when((share(r) > low) & (share(r) < high), 0).otherwise(1).cast("long")
    shares = links.agg(outside("val").alias("val_share"), outside("test").alias("test_share"))
    count = lambda name, d: d.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    return reduce(DataFrame.unionByName, [
        shares.unpivot([], shares.columns, "check", "n_bad"),
        count("several_roles", links.groupBy(keys).agg(F.countDistinct("role").alias("k")).where("k > 1")),
        count("alien", links.join(positives, keys, "left_anti")),
        count("no_role", positives.join(links, keys, "left_anti")),
    ])


def looks_common(name: Column) -> Column:
    """At most 40 characters, none of the rejected forms, and letters for at least 70 % of it."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    kept = (F.length(name) > 0) & (F.length(name) <= 40) & (letters / F.length(name) >= 0.7)
    return reduce(lambda a, p: a & ~name.rlike(p), REJECTED, kept)


def common_name(names: Column) -> Column:
    """The shortest common-looking name, the first of equals; null if there is none."""
    kept = F.filter(names, lambda n: F.coalesce(looks_common(n), F.lit(False)))
    ranked = F.transform(kept, lambda n, i: F.struct(F.length(n).alias("size"), i.alias("at"), n.alias("name")))
    return F.array_min(ranked)["name"]


def question(a: Column, b: Column, label: Column) -> Column:
    """The question put to a scorer about a pair and a label."""
    return F.concat(F.lit("A: "), a, F.lit("\nB: "), b, F.lit("\nLabel: "), label, F.lit("\nQuestion: do A and B together have the label "), label, F.lit("?\nAnswer:"))
