"""Samples of scored edges for a prompted scorer, examples for its prompt, and its pass over them."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import dense_id, hash32
from .graph import edge_key


def stratified(edges: DataFrame, n_pos: int, n_neg: int, seed: int = 17) -> DataFrame:
    """sample_idx, pair_id, label_index, y: so many edges of each class by hash, then all in the order of another hash."""
    ranked = edges.withColumn("_h", hash32(edge_key(), seed))
    first = lambda y, n: ranked.where(F.col("y") == y).orderBy("_h", "pair_id", "label_index").limit(n)
    some = first(1, n_pos).unionByName(first(0, n_neg)).withColumn("_o", hash32(edge_key(), seed + 1))
    return dense_id(some, ["_o", "pair_id", "label_index"], "sample_idx").select("sample_idx", "pair_id", "label_index", "y")


def few_shot(edges: DataFrame, pairs: DataFrame, labels: DataFrame, k_pos: int = 3, k_neg: int = 3, seed: int = 19) -> DataFrame:
    """example, y, a, b, label: examples of training edges with the names a prompt needs, positives first."""
    some = stratified(edges, k_pos, k_neg, seed)
    named = some.join(pairs.select("pair_id", F.col("e1").alias("a"), F.col("e2").alias("b")), "pair_id").join(labels.select("label_index", F.col("label_name").alias("label")), "label_index")
    order = Window.orderBy(F.desc("y"), "sample_idx")  # k_pos + k_neg rows
    return named.withColumn("example", F.row_number().over(order) - 1).select("example", "pair_id", "label_index", "y", "a", "b", "label")


def by_split(sample: DataFrame, splits: DataFrame) -> DataFrame:
    """split, n: how many rows of a sample have their pair in each split."""
    return sample.join(splits.select("pair_id", "split"), "pair_id", "left").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def in_sample_order(predictions: DataFrame, sample: DataFrame) -> DataFrame:
    """Predictions (pair_id, label_index, ...) with sample_idx, in its order; sample rows without a prediction are left out."""
    return predictions.join(sample.select("sample_idx", "pair_id", "label_index"), ["pair_id", "label_index"]).orderBy("sample_idx")


def transcripts(sample: DataFrame, pairs: DataFrame, labels: DataFrame, examples: list[tuple[str, int]], system: str, swapped: bool = False) -> DataFrame:
    """sample_idx, pair_id, label_index, y, messages: system turn, a question and answer for each example, then the question of the row."""
    from .audits import question

    a, b = ("e2", "e1") if swapped else ("e1", "e2")
    rows = sample.join(pairs, "pair_id").join(labels.select("label_index", "label_name"), "label_index")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    shots = [t for q, y in examples for t in (turn("user", F.lit(q)), turn("assistant", F.lit("Yes" if y else "No")))]
    messages = F.array(turn("system", F.lit(system)), *shots, turn("user", question(F.col(a), F.col(b), F.col("label_name"))))
    return rows.select("sample_idx", "pair_id", "label_index", "y", messages.alias("messages"))


def ask(prompts: DataFrame, scorer: Callable[[list[list[tuple[str, str]]]], list[float]], threshold: float = 0.5) -> DataFrame:
    """sample_idx, pair_id, label_index, y, p_yes, predicted: a pluggable scorer of message lists, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = scorer([[(m["role"], m["content"]) for m in x] for x in b["messages"]])
            yield b[["sample_idx", "pair_id", "label_index", "y"]].assign(p_yes=p)

    got = prompts.mapInPandas(run, "sample_idx long, pair_id long, label_index long, y int, p_yes double")
    return got.withColumn("predicted", (F.col("p_yes") >= threshold).cast("int"))
