"""Entity mappings (entity, status, payload, key): preconditions, coverage, eligibility of pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import counted
from .clean import stripped
from .enrich import folded


def mapping_checks(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """check, n_bad: entities that aren't mapped, that are there more than once, without payload; ends of pairs without a mapping; repeated pair ids."""
    ends = pairs.select(F.explode(F.array("e1", "e2")).alias("entity")).where("entity IS NOT NULL").distinct()
    return counted(
        not_mapped=mapping.where("status <> 'mapped' OR status IS NULL"),
        repeated=mapping.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        no_payload=mapping.where(F.coalesce(stripped("payload"), F.lit("")) == ""),
        unknown_ends=ends.join(mapping, "entity", "left_anti"),
        repeated_pairs=pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coverage(mapping: DataFrame) -> DataFrame:
    """One row: entities, those mapped and their share, payloads and keys that differ among the mapped."""
    mapped = F.col("status") == "mapped"
    n, m = F.countDistinct("entity"), F.countDistinct(F.when(mapped, F.col("entity")))
    return mapping.agg(
        n.alias("n_entities"), m.alias("n_mapped"), F.round(100 * m / F.nullif(n, F.lit(0)), 2).alias("mapped_pct"),
        F.countDistinct(F.when(mapped, F.col("payload"))).alias("n_payloads"), F.countDistinct(F.when(mapped, F.col("key"))).alias("n_keys"),
    )


def eligibility(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: pairs, those with both ends mapped, the others, and the share of the first."""
    ok = mapping.where("status = 'mapped'").select("entity").distinct()
    flagged = pairs.join(ok.select(F.col("entity").alias("e1"), F.lit(1).alias("a")), "e1", "left").join(ok.select(F.col("entity").alias("e2"), F.lit(1).alias("b")), "e2", "left")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    n = F.count(F.lit(1))
    return flagged.agg(n.alias("n_pairs"), both.alias("both_mapped"), (n - both).alias("missing"), F.round(100 * both / F.nullif(n, F.lit(0)), 2).alias("pair_pct"))


def case_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two names differ after trimming and case folding; null counts as empty."""
    plain = lambda c: folded(F.coalesce(stripped(c), F.lit("")))
    return df.where(plain(a) != plain(b))


def status_ladder(key: Column, pattern: str, found: Column, payload: Column, valid: Column) -> Column:
    """The first of the states that holds: invalid_format, not_found, missing_payload, invalid, mapped. Nulls count as false and as blank."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(key.rlike(pattern)), "invalid_format").when(no(found), "not_found")
        .when(F.trim(F.coalesce(payload, F.lit(""))) == "", "missing_payload").when(no(valid), "invalid").otherwise("mapped")
    )
