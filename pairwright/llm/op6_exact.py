"""Exact dedup against a persistent digest index, all in DataFrame operations.

The index is a table bucketed and sorted by digest. New rows come in batches; each is
reduced to one candidate per digest, a sort-merge anti-join drops the digests that
the index has, and the rest is appended. The query shuffles digests and ids only, the
stage of the pipeline texts once.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, partitions, spread_join, table, text_or_empty, written

#: Runs of white space other than a single blank, which stays as it is.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    """Runs of blank, tab and line-break characters become one blank."""
    return F.regexp_replace(text, SPACES, " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normal_text(text), "UTF-8"), 256)


class DigestIndex:
    """A table (digest binary, doc_id long), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Ends the index, with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")

    def append(self, rows: DataFrame) -> None:
        # dealt out as the buckets are, so that each task writes one file per bucket it holds
        (
            rows.select("digest", "doc_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def add(self, firsts: DataFrame) -> None:
        """Appends the digests that the index lacks. `firsts` has each digest once."""
        if self.exists():
            firsts = firsts.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        self.append(firsts)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each row. Null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.unhex(digest(text_or_empty())).alias("digest"))


def in_batches(rows: DataFrame, index: DigestIndex, batches: int) -> None:
    """Adds digests (doc_id, digest) to the index in batches of ascending doc_id, those of null doc_id last.

    Each batch is reduced to its smallest doc_id of each digest, which is summed up
    before the shuffle, and goes through the anti-join with what the index holds.
    """
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    bounds = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(bounds, bounds[1:]):
        some = F.lit(True) if low is None else F.col("doc_id") > low
        if high is not None:
            some &= F.col("doc_id") <= high
        elif low is not None:
            some |= F.col("doc_id").isNull()
        index.add(rows.where(some).groupBy("digest").agg(F.min("doc_id").alias("doc_id")))


def deduplicated(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """Adds the table to the index and returns doc_id, keep_id, group_size, kept, text_sha256 per row.

    The row that stays is the one the index holds, so that rows of an earlier batch
    win over those of a later one. Equal rows with equal doc_id: all carry kept where
    doc_id = keep_id. Null doc_ids never stay unless all of a group are null (keep_id
    is then null and kept is false). group_size counts the rows of this table. Null
    and empty texts are equal; long texts count whole; other columns are left out,
    whatever their names. An empty table gives no rows.
    """
    rows = written(digests(docs), "digests")  # the texts are read once
    in_batches(rows, index, batches)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    kept = index.read().select("digest", F.col("doc_id").alias("keep_id"))
    groups = written(sizes.hint("merge").join(kept, "digest").withColumn("_n", F.col("group_size")), "groups")
    return spread_join(rows, groups, "digest", "_n", rows.count()).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: Batches in which a whole table goes through its index.
BATCHES = 4


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def row_key(doc_id: Column, text_digest: Column) -> Column:
    """16 bytes that stand for the doc_id and the text of a row, for null ones too."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), text_digest)))


def keep_rows(docs: DataFrame, keys: DataFrame, key: Column, seen: DataFrame) -> DataFrame:
    """The rows of `docs` whose key is one of `keys` (one binary column), of rows of an equal key one.

    `seen` has the key of every row, in a written frame. Texts cross once: the join and
    the choice of one go by the same key. The keys grow with the documents, so they are
    never broadcast, but for those of more than a share of the rows, at most 4 x
    partitions: rows of such a key aren't brought together, each task sends on one.
    """
    name = free_name(docs, "row")
    keyed, keys, columns = docs.withColumn(name, key), keys.toDF(name), [F.col(f"`{c}`") for c in docs.columns]
    limit = max(1, seen.count() // (4 * partitions(docs.sparkSession)))
    counts = seen.toDF(name).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    crowded = written(counts.where(F.col("n") > limit).select(name), "crowded")
    if crowded.isEmpty():
        return keyed.join(keys.hint("merge"), name, "left_semi").dropDuplicates([name]).select(*columns)
    hot = F.broadcast(crowded)
    few = keyed.join(F.broadcast(crowded.join(keys, name, "left_semi")), name, "left_semi").dropDuplicates([name])
    many = keyed.join(hot, name, "left_anti").join(keys.hint("merge"), name, "left_semi").dropDuplicates([name])
    return few.unionByName(many).select(*columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that stay, with their columns as they are; of rows that share doc_id and text one.

    The index decides who stays by digest and doc_id; the texts are read once more
    and a semi-join keeps those rows. Rows of a null doc_id stay only where no row of
    their text has one. Null and empty texts are equal; an empty table gives none.
    """
    index = fresh_index(spark)
    rows = written(digests(docs), "digests")
    in_batches(rows, index, BATCHES)
    key = row_key(F.col("doc_id"), F.col("digest")).alias("row")
    return keep_rows(docs, index.read().select(key), row_key(docs["doc_id"], F.unhex(digest(text_or_empty()))), rows.select(key))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = deduplicated(table(spark, sf_dir, "documents"), index, BATCHES)
    index.drop()  # what the result reads is written by now
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
