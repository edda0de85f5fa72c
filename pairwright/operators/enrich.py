"""Landed JSON responses to typed rows: bindings, entities, claims, synonyms, coverage. Built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import dense_id

BINDINGS = "results struct<bindings: array<struct<key: struct<value: string>, item: struct<value: string>>>>"
ENTITIES = (
    "entities map<string, struct<missing: string, labels: map<string, struct<value: string>>, descriptions: map<string, struct<value: string>>, "
    "aliases: map<string, array<struct<value: string>>>, claims: map<string, array<string>>>>"
)
COMPOUNDS = "PropertyTable struct<Properties: array<struct<CID: bigint, SMILES: string, Title: string>>>"


def _none() -> Column:
    return F.array().cast("array<string>")


#: Compares and orders strings without regard to case in any script, a final sigma like another one.
CASELESS = "UNICODE_CI"


def folded(x: Column) -> Column:
    """The trimmed text, equal to and ordered with others whatever their case; capitals make ss of a sharp s, which the collation alone keeps apart."""
    return F.collate(F.upper(F.trim(x)), CASELESS)


def first_spellings(names: Column, drop: Column | None = None) -> Column:
    """Trimmed names without blanks, one a spelling that differs by more than case (the first), without `drop`, in an order without case. Null gives none."""
    trimmed = F.filter(F.transform(F.coalesce(names, _none()), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, folded), folded(x)) == i + 1)
    if drop is not None:
        kept = F.filter(kept, lambda x: ~folded(x).eqNullSafe(folded(drop)))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct(folded(x).alias("k"), x.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def definitions(found: Column) -> Column:
    """Distinct (source, value) without blank values, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda d: F.struct(d["source"].alias("source"), F.trim(d["value"]).alias("value"))), lambda d: d["value"] != "")))


def as_list(found: Column) -> Column:
    """JSON of a list or of one value as a list of JSON texts; null stays null."""
    text = F.trim(found)
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def release(path: Column) -> Column:
    """A release such as 2024AB in a text, else current."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([0-9]{4}[A-Z]{2})", 1), F.lit("")), F.lit("current"))


def match_status(n: Column, failed: Column | None = None) -> Column:
    ladder = F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous")
    return ladder if failed is None else F.when(failed, "failed").otherwise(ladder)


def bindings(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """key, ids (distinct, first seen first), status of every key; `responses` has batch and body. Ids are last path segments; a key without bindings has no ids."""
    rows = responses.select("batch", F.posexplode(F.from_json("body", BINDINGS)["results"]["bindings"]).alias("at", "b"))
    seen = rows.select(F.col("b.key.value").alias("key"), F.substring_index("b.item.value", "/", -1).alias("id"), "batch", "at")
    first = seen.groupBy("key", "id").agg(F.min(F.struct("batch", "at")).alias("at"))
    ids = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("ids"))
    out = keys.join(ids, "key", "left").select("key", F.coalesce("ids", _none()).alias("ids"))
    return out.withColumn("status", match_status(F.size("ids")))


def entities(responses: DataFrame, language: str = "en") -> DataFrame:
    """id, missing, label, description, aliases, claims: one row an entity of the bodies. Absent languages give null and no aliases."""
    e = responses.select(F.explode(F.from_json("body", ENTITIES)["entities"]).alias("id", "e"))
    of = lambda c: F.try_element_at(F.col(f"e.{c}"), F.lit(language))
    label = of("labels")["value"]
    return e.select(
        "id", F.col("e.missing").isNotNull().alias("missing"), label.alias("label"), of("descriptions")["value"].alias("description"),
        first_spellings(F.transform(of("aliases"), lambda a: a["value"]), label).alias("aliases"), F.col("e.claims").alias("claims"),
    )


def claim_values(claims: Column, name: str) -> Column:
    """Distinct sorted values of a property: strings as they are, objects by their id."""
    found = F.coalesce(F.try_element_at(claims, F.lit(name)), _none())
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.id")), x))))


def schemed(claims: Column, schemes: dict[str, str]) -> Column:
    """array<struct<scheme, property, value>> over the properties of a scheme table, in its order."""
    def part(name: str, scheme: str) -> Column:
        return F.transform(claim_values(claims, name), lambda v: F.struct(F.lit(scheme).alias("scheme"), F.lit(name).alias("property"), v.alias("value")))

    return F.flatten(F.array(*[part(*x) for x in schemes.items()]))


def target_names(rows: DataFrame, ids: str, names: DataFrame, name: str) -> DataFrame:
    """Adds the names (id, name) of the targets in the array column `ids`, in its order; unknown ones are ''."""
    one = rows.select("id", F.posexplode(ids).alias("_at", "_target")).join(names.select(F.col("id").alias("_target"), "name"), "_target", "left")
    back = one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("name", F.lit("")).alias("n")))), lambda s: s["n"]).alias(name))
    return rows.join(back, "id", "left").withColumn(name, F.coalesce(name, _none()))


def metadata(found: DataFrame, schemes: dict[str, str]) -> DataFrame:
    """One canonical row an entity: counts, flags, nested columns as JSON text."""
    codes = schemed(F.col("claims"), schemes)
    rows = found.select("id", "missing", "label", "description", "aliases", codes.alias("codes"))
    return rows.select(
        "id", F.when(F.col("missing"), "missing").otherwise("found").alias("status"), F.coalesce("label", F.lit("")).alias("label"),
        F.to_json("aliases").alias("aliases_json"), F.to_json("codes").alias("codes_json"),
        F.size("aliases").cast("long").alias("n_aliases"), F.size("codes").cast("long").alias("n_codes"), (F.coalesce("description", F.lit("")) != "").alias("has_description"),
    )


def coverage(rows: DataFrame) -> DataFrame:
    """section, metric, value: status shares, fields filled among the found, alias quantiles among them; one pass, then unpivoted."""
    found = F.col("status") == "found"
    n = F.when(found, F.col("n_aliases"))
    share = lambda c: F.round(100 * F.count_if(found & c) / F.nullif(F.count_if(found), F.lit(0)), 2)
    got = rows.agg(
        F.count(F.lit(1)).cast("double").alias("status.rows"), F.round(100 * F.count_if(found) / F.count(F.lit(1)), 2).alias("status.found_pct"),
        share(F.json_array_length("aliases_json") > 0).alias("fields.aliases_pct"), share(F.json_array_length("codes_json") > 0).alias("fields.codes_pct"), share(F.col("has_description")).alias("fields.description_pct"),
        F.round(F.avg(n), 6).alias("aliases.mean"), *[F.percentile(n, F.lit(q)).alias(f"aliases.p{int(q * 100)}") for q in (0.5, 0.75, 0.9, 0.95)], F.max(n).cast("double").alias("aliases.max"),
    )
    long = got.unpivot([], [f"`{c}`" for c in got.columns], "_m", "value")
    name = F.regexp_replace("_m", "`", "")
    return long.select(F.substring_index(name, ".", 1).alias("section"), F.substring_index(name, ".", -1).alias("metric"), "value")


def compounds(responses: DataFrame) -> DataFrame:
    """id, payload, name of every compound in the bodies; a malformed body gives none."""
    return responses.select(F.explode(F.from_json("body", COMPOUNDS)["PropertyTable"]["Properties"]).alias("c")).select(F.col("c.CID").alias("id"), F.col("c.SMILES").alias("payload"), F.col("c.Title").alias("name"))


def display_name(name: Column, payload: Column) -> tuple[Column, Column]:
    """The name and where it is from: the trimmed name, or the marked payload where that is blank."""
    given = F.nullif(F.trim(name), F.lit(""))
    return F.coalesce(given, F.concat(F.lit("SMILES:"), payload)), F.when(given.isNotNull(), "name").otherwise("payload")


def duplicate_groups(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """attribute, value, n, first, last of values that several rows share; nulls don't count."""
    long = rows.select(key, *[F.col(a).cast("string") for a in attributes]).unpivot([key], attributes, "attribute", "value").where("value IS NOT NULL")
    return long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).where("n > 1")


def duplicate_members(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """attribute, place, value, n, member: the groups of duplicate_groups, numbered from 0 within their attribute from the largest, with a row for each member; ties by value.

    Members stay rows, so that a group of any size is spread over tasks.
    """
    groups = duplicate_groups(rows, key, attributes)
    by = ["attribute", F.desc("n"), "value"]
    numbered = dense_id(groups.select("attribute", "value", "n"), by, "_i")
    firsts = numbered.groupBy("attribute").agg(F.min("_i").alias("_first"))  # a row an attribute
    placed = numbered.join(F.broadcast(firsts), "attribute").select("attribute", "value", "n", (F.col("_i") - F.col("_first")).alias("place"))
    long = rows.select(F.col(key).alias("member"), *[F.col(a).cast("string") for a in attributes]).unpivot(["member"], attributes, "attribute", "value")
    return long.join(placed, ["attribute", "value"]).select("attribute", "place", "value", "n", "member")


def key_number(key: Column, pattern: str = "^[A-Za-z]+([0-9]{9})$") -> Column:
    """The number in a key of the pattern's form, null for any other."""
    return F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).cast("long")


def semantic_types(found: Column) -> Column:
    """Distinct trimmed names without blanks, sorted; null gives none."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(found, _none()), lambda x: F.trim(x)), lambda x: x != "")))


def synonyms(body: Column) -> Column:
    """The synonym list of a compound response; empty where it is absent or malformed."""
    parsed = F.from_json(body, "InformationList struct<Information: array<struct<CID: bigint, Synonym: array<string>>>>")
    return F.coalesce(F.get(parsed["InformationList"]["Information"], F.lit(0))["Synonym"], _none())


def richness(rows: DataFrame) -> DataFrame:
    """class, n, pct (of all rows): found entities by what they have beside a name."""
    found, aliases, text = F.col("status") == "found", F.col("n_aliases") > 0, F.col("has_description")
    classes = {"name": ~aliases & ~text, "name+aliases": aliases & ~text, "name+description": ~aliases & text, "name+aliases+description": aliases & text}
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(found & c).alias(k) for k, c in classes.items()])
    return counts.unpivot(["_n"], [f"`{k}`" for k in classes], "class", "n").select(F.regexp_replace("class", "`", "").alias("class"), "n", F.round(100 * F.col("n") / F.nullif(F.col("_n"), F.lit(0)), 2).alias("pct"))


def exceptions(rows: DataFrame) -> DataFrame:
    """id, status of the entities that weren't found, null states too."""
    return rows.where(~F.col("status").eqNullSafe("found")).select("id", "status")
