"""Cleaning: associations to canonical triples, labels, pairs and positives; with checks."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import dense_groups, dense_id, written
from .enrich import folded

KEYS = ["entity_1", "entity_2", "label_id", "label_name"]


def stripped(c: str) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, changed: how many values stripping changes; nulls don't count."""
    counts = df.agg(*[F.sum(F.coalesce((F.col(c) != stripped(c)).cast("long"), F.lit(0))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "changed")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing: nulls and values of white space alone, in one pass."""
    counts = df.agg(*[F.sum(F.when(F.coalesce(stripped(c), F.lit("")) == "", 1).otherwise(0)).cast("long").alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def name_conflicts(df: DataFrame, caseless: bool = False) -> DataFrame:
    """Of each direction (id to names, names to ids): how many keys have several values. Blank names are left out; `caseless` names that differ in case alone are one."""
    name = folded(F.col("label_name")) if caseless else F.col("label_name")
    named = df.where(F.trim("label_name") != "").select("label_id", name.alias("label_name")).distinct()
    ids = named.groupBy("label_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("id_to_names").alias("check"), "n_bad")
    names = named.groupBy("label_name").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("name_to_ids").alias("check"), "n_bad")
    return ids.unionByName(names)


def canonical(df: DataFrame) -> DataFrame:
    """Exact duplicates leave, then ends are ordered as strings."""
    return df.dropDuplicates(KEYS).select(F.least("entity_1", "entity_2").alias("e1"), F.greatest("entity_1", "entity_2").alias("e2"), "label_id", "label_name")


def self_pairs(df: DataFrame) -> DataFrame:
    """Rows, entities and labels of pairs of an entity with itself."""
    return canonical(df).where("e1 = e2").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("e1").alias("n_pairs"), F.countDistinct("label_id").alias("n_labels"))


def triples(df: DataFrame) -> DataFrame:
    """Unique (e1, e2, label_id) without self-pairs; of several names the largest."""
    ends = df.select(F.least("entity_1", "entity_2").alias("e1"), F.greatest("entity_1", "entity_2").alias("e2"), "label_id", "label_name")
    return ends.where("e1 <> e2").groupBy("e1", "e2", "label_id").agg(F.max("label_name").alias("label_name"))  # repeated rows collapse here too


def frequency(t: DataFrame) -> DataFrame:
    """label_id, label_name, n. Names may be numbers in the order of the names."""
    name = F.expr("nullif(label_name, '')") if t.schema["label_name"].dataType.typeName() == "string" else F.col("label_name")
    return t.groupBy("label_id").agg(F.max(name).alias("label_name"), F.count(F.lit(1)).alias("n"))


@dataclass
class Prepared:
    triples: DataFrame
    labels: DataFrame  # label_id, label_name, n, label_index
    pairs: DataFrame  # e1, e2, pair_id
    positives: DataFrame  # pair_id, label_index


def kept_labels(t: DataFrame, min_pairs: float | None = None) -> DataFrame:
    """label_id, label_name, n, label_index of the labels that stay: without `min_pairs` those of at least the mean frequency."""
    freq = frequency(t)
    least = freq.agg(F.avg("n").alias("least")) if min_pairs is None else t.sparkSession.range(1).select(F.lit(float(min_pairs)).alias("least"))
    # one row on the right
    return dense_id(freq.join(F.broadcast(least), F.col("n") >= F.col("least")).drop("least"), ["label_id"], "label_index")


def numbered(t: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and positives of the triples of some labels."""
    kept = t.join(labels.select("label_id", "label_index"), "label_id").select("e1", "e2", "label_index")
    rows = dense_groups(kept, ["e1", "e2"], "pair_id", "_new")
    return rows.where("_new").select("e1", "e2", "pair_id"), rows.select("pair_id", "label_index")


def prepare(df: DataFrame, min_pairs: float | None = None) -> Prepared:
    """The chain from associations to positives. Without `min_pairs`, labels of at least the mean frequency stay.

    Ends, labels and names may be of any type that has an order: numbers in the order of
    the texts that they stand for give the same ids in less time and space.
    """
    t = written(triples(df))
    labels = kept_labels(t, min_pairs)
    return Prepared(t, labels, *numbered(t, labels))


def pair_checks(pairs: DataFrame) -> DataFrame:
    """check, n_bad: order of the ends, self-pairs, repeated pairs, ids from 0 without gaps."""
    s = pairs.agg(
        F.sum((F.col("e1") > F.col("e2")).cast("long")).alias("unordered"),
        F.sum((F.col("e1") == F.col("e2")).cast("long")).alias("self"),
        (F.count(F.lit(1)) - F.countDistinct("e1", "e2")).alias("repeated"),
        (F.max("pair_id") + 1 - F.count(F.lit(1)) + F.min("pair_id") + F.count(F.lit(1)) - F.countDistinct("pair_id")).alias("gaps"),
    )
    return s.unpivot([], s.columns, "check", "n_bad")


def label_checks(p: Prepared) -> DataFrame:
    """check, n_bad: pairs without a label, repeated positives, labels whose positives aren't their frequency."""
    none = p.pairs.join(p.positives, "pair_id", "left_anti").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("no_label").alias("check"), "n_bad")
    twice = p.positives.groupBy("pair_id", "label_index").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("repeated").alias("check"), "n_bad")
    n = p.positives.groupBy("label_index").agg(F.count(F.lit(1)).alias("m"))
    off = p.labels.join(n, "label_index", "left").where(~F.col("n").eqNullSafe(F.col("m"))).agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("frequency").alias("check"), "n_bad")
    return reduce(DataFrame.unionByName, [none, twice, off])


def audit(df: DataFrame, p: Prepared) -> DataFrame:
    """metric, value: counts along the chain, order statistics of label frequencies and of labels per pair; frames of one row each meet at the end."""
    n = F.count(F.lit(1))
    own = F.col("entity_1") == F.col("entity_2")
    per, freq = p.positives.groupBy("pair_id").agg(n.alias("k")), frequency(p.triples)
    spread = lambda c, name: [F.min(c).alias(f"{name}_min"), F.percentile(c, F.lit(0.5)).alias(f"{name}_median"), F.round(F.avg(c), 6).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max")]
    entities = lambda d, name: d.select(F.explode(F.array("e1", "e2")).alias("e")).agg(F.countDistinct("e").alias(name))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), [
        df.agg(n.alias("raw_rows")),
        df.dropDuplicates(KEYS).agg(n.alias("distinct_rows"), F.count_if(own).alias("self_rows"), F.countDistinct(F.when(own, F.col("entity_1"))).alias("self_pairs")),
        p.triples.agg(n.alias("triples")), p.triples.select("e1", "e2").distinct().agg(n.alias("pairs_before")), entities(p.triples, "entities_before"),
        freq.agg(n.alias("labels_before"), *spread("n", "label_frequency")),
        p.labels.agg(n.alias("labels_kept")), p.pairs.agg(n.alias("pairs")), entities(p.pairs, "entities"), p.positives.agg(n.alias("positives")), per.agg(*spread("k", "labels_per_pair")),
    ])
    c = F.col
    row = row.withColumns({
        "exact_duplicates": c("raw_rows") - c("distinct_rows"), "rows_without_self": c("distinct_rows") - c("self_rows"), "canonical_duplicates": c("distinct_rows") - c("self_rows") - c("triples"),
        "labels_excluded": c("labels_before") - c("labels_kept"), "triples_excluded": c("triples") - c("positives"), "cells": c("pairs") * c("labels_kept"),
    })
    row = row.select([c(x).cast("double").alias(x) for x in row.columns])
    return row.unpivot([], row.columns, "metric", "value")


def conflict_examples(df: DataFrame, n: int = 3) -> DataFrame:
    """check, key, values: of each direction the first `n` keys that have several values, with the first `n` of these, by name. Blank names are left out."""
    named = df.where(F.trim("label_name") != "").select("label_id", "label_name").distinct()
    way = lambda name, k, v: named.select(F.lit(name).alias("check"), F.col(k).alias("key"), F.col(v).alias("value"))
    both = way("id_to_names", "label_id", "label_name").unionByName(way("name_to_ids", "label_name", "label_id"))
    place = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    keys = both.groupBy("check", "key").count().where("count > 1").withColumn("_r", place(["check"], "key")).where(F.col("_r") <= n).select("check", "key")
    values = both.join(keys, ["check", "key"], "left_semi").withColumn("_r", place(["check", "key"], "value")).where(F.col("_r") <= n)
    return values.groupBy("check", "key").agg(F.array_sort(F.collect_list("value")).alias("values"))
