"""The bipartite graph of pairs and labels: degrees, link split, negatives, structural scores, neighbour sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import vector_sums
from ..functions.selection import before, keys_at
from ..functions.shared import hash32, written
from .checks import CheckFailed, counted


def degrees(positives: DataFrame) -> DataFrame:
    """side, node, degree of both sides."""
    side = lambda c: positives.groupBy(F.col(c).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(c).alias("side"), "node", "degree")
    return side("pair_id").unionByName(side("label_index"))


def edge_key() -> Column:
    return F.concat_ws("-", "pair_id", "label_index")


def link_split(positives: DataFrame, seed: int = 7) -> DataFrame:
    """Adds role: 10 % test, 10 % val, and of the rest 30 % supervise and 70 % carry messages; by rank of the edge's hash."""
    keyed, by = positives.withColumn("_h", hash32(edge_key(), seed)), ["_h", "pair_id", "label_index"]
    val, train, message = keys_at(keyed, by, lambda n: [n // 10, n // 10 * 2, n // 10 * 2 + (n - n // 10 * 2) * 3 // 10])
    role = F.when(before(by, val), "test").when(before(by, train), "val").when(before(by, message), "supervise").otherwise("message")
    return keyed.select("pair_id", "label_index", role.alias("role"))


def negatives(positives: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """At most one per positive: its pair with a label drawn by hash, dropped where that is a positive anywhere."""
    n = labels.agg(F.count(F.lit(1)).alias("_n"))
    drawn = positives.join(F.broadcast(n)).select("pair_id", F.pmod(hash32(edge_key(), seed), F.col("_n")).alias("label_index")).distinct()
    return drawn.join(positives, ["pair_id", "label_index"], "left_anti")


def required_negatives(positives: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """negatives(), or CheckFailed where none can be drawn."""
    drawn = negatives(positives, labels, seed)
    if drawn.isEmpty():
        raise CheckFailed("no negative can be drawn")
    return drawn


def messages(links: DataFrame) -> DataFrame:
    """split, pair_id, label_index: the edges that carry messages where a split is judged: val sees all training edges, test those of val too."""
    role = F.col("role")
    sees = F.when(role == "message", F.array(*map(F.lit, ("train", "val", "test")))).when(role == "supervise", F.array(F.lit("val"), F.lit("test"))).when(role == "val", F.array(F.lit("test")))
    return links.select(F.explode(sees).alias("split"), "pair_id", "label_index")


def message_checks(seen: DataFrame, links: DataFrame) -> DataFrame:
    """check, n_bad: judged edges that are messages of their own split, messages that the next split lacks, messages that aren't edges."""
    keys = ["split", "pair_id", "label_index"]
    judged = links.where("role <> 'message'").select(F.when(F.col("role") == "supervise", "train").otherwise(F.col("role")).alias("split"), "pair_id", "label_index")
    later = seen.where("split <> 'test'").withColumn("split", F.when(F.col("split") == "train", "val").otherwise("test"))
    return counted(leaked=judged.join(seen, keys, "left_semi"), not_nested=later.join(seen, keys, "left_anti"), alien=seen.join(links, keys[1:], "left_anti"))


def edge_lineage(edges: DataFrame, pairs: DataFrame, labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """pair_id, label_index, has_pair, has_label, has_vectors (of both ends), name_hash (SHA-256 of the label's name): each edge traced to the tables that it was made of.

    These hold a key once; what isn't there gives false, and a null hash.
    """
    end = lambda c: vectors.select(F.col("entity").alias(c), F.lit(True).alias(f"_{c}"))
    traced = (
        edges.select("pair_id", "label_index")
        .join(pairs.select("pair_id", "e1", "e2", F.lit(True).alias("_p")), "pair_id", "left")
        .join(labels.select("label_index", F.sha2("label_name", 256).alias("name_hash"), F.lit(True).alias("_l")), "label_index", "left")
        .join(end("e1"), "e1", "left").join(end("e2"), "e2", "left")
    )
    there = lambda c: F.coalesce(c, F.lit(False))
    return traced.select("pair_id", "label_index", there(F.col("_p")).alias("has_pair"), there(F.col("_l")).alias("has_label"), there(F.col("_e1") & F.col("_e2")).alias("has_vectors"), "name_hash")


def cell_sides(splits: DataFrame, positives: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What cells are made of: test pairs (pair_id, pd, ys) with the degree sum of their ends and their positives, and labels (label_index, ld) with their degrees.

    Degrees come from training pairs alone.
    """
    train = splits.where("split = 'train'").select("pair_id", "e1", "e2")
    marked = positives.join(splits.where("split <> 'val'").select("pair_id", "split"), "pair_id")
    degree = marked.where("split = 'train'").groupBy("label_index").agg(F.count(F.lit(1)).alias("ld"))
    of_label = labels.select("label_index").join(degree, "label_index", "left").select("label_index", F.coalesce("ld", F.lit(0)).alias("ld"))
    ends = train.select(F.explode(F.array("e1", "e2")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("d"))
    truth = marked.where("split = 'test'").groupBy("pair_id").agg(F.collect_set("label_index").alias("ys"))
    test = (
        splits.where("split = 'test'")
        .join(ends.select(F.col("e").alias("e1"), F.col("d").alias("d1")), "e1", "left")
        .join(ends.select(F.col("e").alias("e2"), F.col("d").alias("d2")), "e2", "left")
        .select("pair_id", (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("pd"))
    )
    return test.join(truth, "pair_id", "left"), of_label


def cells_of(test: DataFrame, of_label: DataFrame) -> DataFrame:
    """structural_cells of what cell_sides gave and a query has stored.

    A test pair's positives are one row until its cells are made, so that no cell is
    shuffled. The label side is the label table, which is small by its nature, and is
    broadcast: without the hint its unknown size makes a product of partitions, whose
    tasks are those of both sides multiplied.
    """
    top = of_label.agg(F.max("ld").alias("lm"))
    top_pair = test.agg(F.max("pd").alias("pm"))
    cells = test.crossJoin(F.broadcast(of_label)).join(F.broadcast(top)).join(F.broadcast(top_pair))  # every label of every test pair is a cell
    y = F.coalesce(F.array_contains("ys", F.col("label_index")), F.lit(False)).cast("int")
    return cells.select("pair_id", "label_index", y.alias("y"), ((F.col("ld") + F.col("pd")) / (F.col("lm") + F.col("pm"))).alias("a"), (F.col("ld") / F.col("lm")).alias("b"))


def structural_cells(splits: DataFrame, positives: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored cells of the test pairs and all labels: pair_id, label_index, y, a (degree sum), b (label degree), both from 0 to 1."""
    return cells_of(*map(written, cell_sides(splits, positives, labels)))


def neighbour_sum(positives: DataFrame, vectors: DataFrame) -> DataFrame:
    """label_index, dim, value: sum of the vectors (pair_id, v) of a label's pairs; a vector stays one row until it is summed."""
    sums = vector_sums(positives.join(vectors, "pair_id"), "label_index")
    return sums.select("label_index", F.posexplode("v").alias("dim", "x")).select("label_index", "dim", F.round("x", 4).alias("value"))


def hops(positives: DataFrame, vectors: DataFrame, n: int = 2) -> DataFrame:
    """side, node, v after n rounds of sums: labels from pairs (pair_id, v), pairs from labels, and so on. One row a node through each shuffle of sums."""
    at, other = "pair_id", "label_index"
    for _ in range(n):
        vectors = vector_sums(positives.join(vectors.select(at, "v"), at), other)
        at, other = other, at
    return vectors.select(F.lit(at).alias("side"), F.col(at).cast("long").alias("node"), "v")


def neighbour_layer(sums: DataFrame, own: DataFrame, of_sums: DataFrame, of_own: DataFrame) -> DataFrame:
    """node, out, value: a node's neighbour sums (node, dim, value) by one weight matrix (dim, out, w) and its own vector by another, added."""
    part = lambda x, w: x.join(w, "dim").select("node", "out", (F.col("value") * F.col("w")).alias("value"))
    return part(sums, of_sums).unionByName(part(own, of_own)).groupBy("node", "out").agg(F.sum("value").alias("value"))
