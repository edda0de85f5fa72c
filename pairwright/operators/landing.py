"""Landed responses as VARIANT: their state told by HTTP status and body, values of any JSON type, lists and single values alike."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a response.
OK, EMPTY, FAILED, MALFORMED = "ok", "empty", "failed", "malformed"


def landed(responses: DataFrame) -> DataFrame:
    """Adds `state` and `parsed` (VARIANT) to responses (http_status int, body string).

    404 is empty: the source knows nothing. Another status than 200, or none, is failed: to
    be asked again. A body of status 200 that isn't JSON is malformed. Only ok ones are parsed.
    """
    body = F.try_parse_json("body")
    state = (
        F.when(F.col("http_status") == 404, EMPTY).when(~F.col("http_status").eqNullSafe(200), FAILED)
        .when(body.isNull(), MALFORMED).otherwise(OK)
    )
    return responses.withColumn("state", state).withColumn("parsed", F.when(F.col("state") == OK, body))


def as_values(found: Column) -> Column:
    """A VARIANT list as an array of its elements, another value as an array of it alone; null and JSON null give none."""
    one = F.when(found.isNull() | F.is_variant_null(found), F.array().cast("array<variant>")).otherwise(F.array(found))
    return F.coalesce(F.try_variant_get(found, "$", "array<variant>"), one)


def results(state: Column, parsed: Column, path: str) -> Column:
    """The values at a path of a response: an empty array if it is empty, null if it failed or is malformed, so that one is told from the other."""
    return F.when(state == EMPTY, F.array().cast("array<variant>")).when(state == OK, as_values(F.try_variant_get(parsed, path, "variant")))


def kind(value: Column) -> Column:
    """string, object, array, number, boolean or null."""
    of = F.schema_of_variant(value)
    return (
        F.when(of == "STRING", "string").when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array")
        .when(of == "BOOLEAN", "boolean").when(value.isNull() | (of == "VOID"), "null").otherwise("number")
    )


def plain_value(value: Column) -> Column:
    """A claim's value as text: a string as it is, an object by its id, a number or boolean as JSON writes it; null for null, lists and objects without an id."""
    of = kind(value)
    return F.when(of == "object", F.try_variant_get(value, "$.id", "string")).when(of.isin("string", "number", "boolean"), F.try_variant_get(value, "$", "string"))


def claim_texts(parsed: Column, name: str) -> Column:
    """Distinct sorted texts of a property's values; an absent property gives none."""
    values = as_values(F.try_variant_get(parsed, f"$.claims.{name}", "variant"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, plain_value), lambda x: x.isNotNull())))


def compounds(rows: DataFrame) -> DataFrame:
    """key, state, id, payload, name: the compounds of each response that landed() has read; one row without a compound where a response has none, so that none is lost."""
    listed = results(F.col("state"), F.col("parsed"), "$.PropertyTable.Properties")
    each = rows.select("key", "state", F.explode_outer(listed).alias("c"))
    of = lambda path, kind: F.try_variant_get("c", path, kind)
    return each.select("key", "state", of("$.CID", "long").alias("id"), of("$.SMILES", "string").alias("payload"), of("$.Title", "string").alias("name"))


def states(rows: DataFrame) -> DataFrame:
    """state, n, and again: how many of them are to be asked again."""
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state").isin(FAILED, MALFORMED)).alias("again"))
