"""Queries over JSON responses. The bodies are made by Spark from the tables, in the form in which a fetcher lands them; SQL states the results from the tables themselves."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import enrich, landing
from ..sources import artifacts

SCHEMES = {"P1": "nation number", "P2": "nation node"}


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def entity_bodies(s: SparkSession, d: str) -> DataFrame:
    """batch, body: customers as entities, 50 a body; every seventh is missing."""
    c = _table(s, d, "customer").join(F.broadcast(_table(s, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    en = lambda x: F.struct(F.struct(x.alias("value")).alias("en"))
    names = F.array(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")), F.lower("n_name"), F.col("n_name"), F.lit(""), F.concat("c_mktsegment", F.lit(" buyer")))
    nation = F.col("c_nationkey").cast("string")
    gone = F.col("c_custkey") % 7 == 0
    e = F.struct(
        F.when(gone, "").alias("missing"), F.when(~gone, en(F.col("c_name"))).alias("labels"), F.when(~gone, en(F.lower("c_mktsegment"))).alias("descriptions"),
        F.when(~gone, F.struct(F.transform(names, lambda x: F.struct(x.alias("value"))).alias("en"))).alias("aliases"),
        F.when(~gone, F.struct(F.array(nation, nation).alias("P1"), F.array(F.struct(F.concat(F.lit("N"), nation).alias("id"))).alias("P2"))).alias("claims"),
    )
    rows = c.select(F.floor(F.col("c_custkey") / 50).alias("batch"), F.struct(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("key"), e.alias("value")).alias("e"))
    return rows.groupBy("batch").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("entities"))).alias("body"))


def binding_bodies(s: SparkSession, d: str) -> DataFrame:
    """batch, body: suppliers bound to nations, two of three, ten nations a body; each binding twice."""
    b = _table(s, d, "supplier").where("s_suppkey % 3 <> 0").select("s_nationkey", "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    row = F.struct(
        "again", "s_suppkey", F.struct(F.concat(F.lit("K"), F.col("s_nationkey").cast("string")).alias("value")).alias("key"),
        F.struct(F.concat(F.lit("http://e.org/entity/S"), F.col("s_suppkey").cast("string")).alias("value")).alias("item"),
    )
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["key"].alias("key"), x["item"].alias("item")))
    return b.groupBy(F.floor(F.col("s_nationkey") / 10).alias("batch")).agg(F.to_json(F.struct(F.struct(listed.alias("bindings")).alias("results"))).alias("body"))


def compound_bodies(s: SparkSession, d: str) -> DataFrame:
    """batch, body: parts as compounds, 100 a body; names of sizes up to 5 are blank."""
    row = F.struct(F.col("p_partkey").cast("long").alias("CID"), F.concat_ws("-", "p_brand", "p_type").alias("SMILES"), F.when(F.col("p_size") <= 5, " ").otherwise(F.col("p_name")).alias("Title"))
    rows = _table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("batch")).agg(F.collect_list(row).alias("r"))
    return rows.select("batch", F.to_json(F.struct(F.struct(F.col("r").alias("Properties")).alias("PropertyTable"))).alias("body"))


def found(s: SparkSession, d: str) -> DataFrame:
    return enrich.entities(entity_bodies(s, d))


def meta(s: SparkSession, d: str) -> DataFrame:
    return enrich.metadata(found(s, d), SCHEMES)


E = """WITH e AS (SELECT 'Q' || c_custkey AS id, c_custkey % 7 = 0 AS missing, c_name, c_mktsegment AS seg, n_name, c_nationkey AS nk FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT *, CASE WHEN missing THEN []::VARCHAR[] WHEN lower(seg || ' buyer') < lower(n_name) THEN [seg || ' buyer', lower(n_name)] ELSE [lower(n_name), seg || ' buyer'] END AS aliases FROM e),
m AS (SELECT id, CASE WHEN missing THEN 'missing' ELSE 'found' END AS status, CASE WHEN missing THEN '' ELSE c_name END AS label,
  CASE WHEN missing THEN '[]' ELSE '["' || array_to_string(aliases, '","') || '"]' END AS aliases_json,
  CASE WHEN missing THEN '[]' ELSE '[{"scheme":"nation number","property":"P1","value":"' || nk || '"},{"scheme":"nation node","property":"P2","value":"N' || nk || '"}]' END AS codes_json,
  len(aliases)::BIGINT AS n_aliases, CASE WHEN missing THEN 0 ELSE 2 END::BIGINT AS n_codes, NOT missing AS has_description FROM a)
"""
query("entity_rows", E + "SELECT id, missing, CASE WHEN missing THEN NULL ELSE c_name END AS label, CASE WHEN missing THEN NULL ELSE lower(seg) END AS description, array_to_string(aliases, '|') AS aliases FROM a", False)(
    lambda s, d: found(s, d).select("id", "missing", "label", "description", F.concat_ws("|", "aliases").alias("aliases"))
)
query("claim_values", E + "SELECT id, CASE WHEN missing THEN '' ELSE nk::VARCHAR END AS p1, CASE WHEN missing THEN '' ELSE 'N' || nk END AS p2 FROM e", False)(
    lambda s, d: found(s, d).select("id", *[F.concat_ws("|", enrich.claim_values(F.col("claims"), p.upper())).alias(p) for p in ("p1", "p2")])
)
query("target_names", E + "SELECT id, CASE WHEN missing OR nk % 5 = 0 THEN '' ELSE n_name END AS targets FROM e", False)(
    lambda s, d: enrich.target_names(
        found(s, d).select("id", enrich.claim_values(F.col("claims"), "P2").alias("ids")), "ids",
        _table(s, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")), "targets",
    ).select("id", F.concat_ws("|", "targets").alias("targets"))
)
query("entity_metadata", E + "SELECT * FROM m", False)(meta)
query("coverage_report", E + """SELECT 'status' AS section, 'rows' AS metric, count(*)::DOUBLE AS value FROM m UNION ALL SELECT 'status', 'found_pct', round(100 * count_if(status = 'found')::DOUBLE / count(*), 2) FROM m
UNION ALL SELECT 'fields', unnest(['aliases_pct', 'codes_pct', 'description_pct']), unnest([round(100 * count_if(n_aliases > 0)::DOUBLE / count(*), 2), round(100 * count_if(n_codes > 0)::DOUBLE / count(*), 2), round(100 * count_if(has_description)::DOUBLE / count(*), 2)]) FROM m WHERE status = 'found'
UNION ALL SELECT 'aliases', unnest(['mean', 'p50', 'p75', 'p90', 'p95', 'max']), unnest([round(avg(n_aliases), 6), quantile_cont(n_aliases, 0.5), quantile_cont(n_aliases, 0.75), quantile_cont(n_aliases, 0.9), quantile_cont(n_aliases, 0.95), max(n_aliases)::DOUBLE]) FROM m WHERE status = 'found'""", False)(
    lambda s, d: enrich.coverage(meta(s, d))
)
query("binding_ids", """SELECT 'K' || n_nationkey AS key, coalesce(string_agg('S' || s_suppkey, '|' ORDER BY s_suppkey), '') AS ids, CASE count(s_suppkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_nationkey = n_nationkey GROUP BY 1""", False)(
    lambda s, d: enrich.bindings(binding_bodies(s, d), _table(s, d, "nation").select(F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("key"))).withColumn("ids", F.concat_ws("|", "ids"))
)


def named(s: SparkSession, d: str) -> DataFrame:
    rows = enrich.compounds(compound_bodies(s, d))
    name, source = enrich.display_name(F.col("name"), F.col("payload"))
    return rows.select("id", name.alias("name"), source.alias("source"), "payload")


query("compound_names", "SELECT p_partkey::BIGINT AS id, CASE WHEN p_size <= 5 THEN 'SMILES:' || p_brand || '-' || p_type ELSE p_name END AS name, CASE WHEN p_size <= 5 THEN 'payload' ELSE 'name' END AS source, p_brand || '-' || p_type AS payload FROM part", False)(named)
query("duplicate_groups", """SELECT attribute, value, count(*) AS n, min(p_partkey)::BIGINT AS first, max(p_partkey)::BIGINT AS last FROM (SELECT p_partkey, 'payload' AS attribute, p_brand || '-' || p_type AS value FROM part
UNION ALL SELECT p_partkey, 'name', CASE WHEN p_size <= 5 THEN 'SMILES:' || p_brand || '-' || p_type ELSE p_name END FROM part) GROUP BY 1, 2 HAVING count(*) > 1""", False)(lambda s, d: enrich.duplicate_groups(named(s, d), "id", ["payload", "name"]))
query("key_batches", "SELECT (r // 100)::BIGINT AS batch, string_agg(k::VARCHAR, ',' ORDER BY k) AS keys, count(*)::BIGINT AS n FROM (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) GROUP BY 1", False)(
    lambda s, d: artifacts.batches(_table(s, d, "customer"), "c_custkey", 100).select("batch", F.concat_ws(",", F.transform("keys", lambda k: k.cast("string"))).alias("keys"), F.size("keys").cast("long").alias("n"))
)
# all columns of orders; dates and fractions in a form that both engines write alike
ORDER_FIELDS = {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_totalprice": "(o_totalprice * 100)::BIGINT::VARCHAR", "o_orderdate": "epoch_us(o_orderdate)::VARCHAR", "o_orderpriority": "o_orderpriority"}
FIELDS = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ORDER_FIELDS.values())
SUMS = ", ".join(f"(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % 4294967296)::BIGINT AS h{i}" for i in range(4))
query("table_fingerprint", f"SELECT count(*) AS n_rows, {SUMS} FROM (SELECT md5({FIELDS}) AS h FROM orders)", False)(lambda s, d: artifacts.fingerprint(plain_orders(s, d)))


def plain_orders(s: SparkSession, d: str) -> DataFrame:
    plain = {"o_totalprice": F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp"))}
    return _table(s, d, "orders").select(*[plain.get(c, F.col(c)).alias(c) for c in ORDER_FIELDS])


RANGES = f"SELECT level, k // (64 * (1::BIGINT << (4 * level)::INT)) AS \"range\", count(*) AS n_rows, {SUMS} FROM (SELECT o_orderkey AS k, md5({FIELDS}) AS h FROM orders), range(4) t(level) GROUP BY 1, 2"
query("range_fingerprints", f"SELECT level::INT AS level, \"range\", n_rows, h0, h1, h2, h3 FROM ({RANGES})", False)(lambda s, d: artifacts.range_fingerprints(plain_orders(s, d), "o_orderkey", 64))


def changed_orders(o: DataFrame) -> DataFrame:
    """Orders with other prices for some, some missing, some twice, and some of new keys.

    An order that is both missing and added again, the first of which has a key beyond a
    million, comes back with another price, and so do those of new keys, which may be
    there already: no change takes back another one.
    """
    k, other = F.col("o_orderkey"), F.col("o_totalprice") + 1
    some = o.where(k % 2003 != 5).withColumn("o_totalprice", F.when(k % 1009 == 7, other).otherwise(F.col("o_totalprice")))
    again = o.where(k % 3001 == 11).withColumn("o_totalprice", F.when(k % 2003 == 5, other).otherwise(F.col("o_totalprice")))
    return some.unionByName(again).unionByName(o.where(k % 4001 == 13).withColumns({"o_orderkey": k + 10_000_000, "o_totalprice": other}))


query("differing_ranges", """WITH o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT k // 64 AS r, 1 AS a, (k % 2003 <> 5)::INT + (k % 3001 = 11)::INT AS b, (k % 2003 = 5 OR k % 1009 = 7 OR k % 3001 = 11)::INT AS x FROM o
UNION ALL SELECT (k + 10000000) // 64, 0, 1, 1 FROM o WHERE k % 4001 = 13) SELECT r::BIGINT AS "range", sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM c GROUP BY 1 HAVING sum(x) > 0""", False)(
    lambda s, d: (lambda o: artifacts.differing_ranges(artifacts.range_fingerprints(o, "o_orderkey", 64), artifacts.range_fingerprints(changed_orders(o), "o_orderkey", 64)))(plain_orders(s, d))
)


def landed_bodies(s: SparkSession, d: str) -> DataFrame:
    """key, http_status, body: a response a customer; some unknown, some failed, some broken, claims as strings, objects, numbers, nulls and single values."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    value = (
        F.when(k % 5 == 0, F.concat(F.lit('["'), nation, F.lit('", "b", "b"]'))).when(k % 5 == 1, F.concat(F.lit('[{"id": "N'), nation, F.lit('"}, {"no": 1}]')))
        .when(k % 5 == 2, F.concat(F.lit("["), nation, F.lit(", null, true]"))).when(k % 5 == 3, F.lit("null")).otherwise(F.concat(F.lit('"'), nation, F.lit('"')))
    )
    body = F.when(k % 11 == 3, F.lit('{"claims": {"P1"')).otherwise(F.concat(F.lit('{"claims": {"P1": '), value, F.lit("}}")))
    return _table(s, d, "customer").select(k.alias("key"), F.when(k % 13 == 4, 404).when(k % 17 == 5, 503).when(k % 19 != 6, 200).cast("int").alias("http_status"), body.alias("body"))


STATE = "CASE WHEN c_custkey % 13 = 4 THEN 'empty' WHEN c_custkey % 17 = 5 OR c_custkey % 19 = 6 THEN 'failed' WHEN c_custkey % 11 = 3 THEN 'malformed' ELSE 'ok' END"
query("landed_claims", f"""SELECT c_custkey AS key, {STATE} AS state, CASE WHEN {STATE} <> 'ok' OR c_custkey % 5 = 3 THEN '' WHEN c_custkey % 5 = 0 THEN c_nationkey || '|b' WHEN c_custkey % 5 = 1 THEN 'N' || c_nationkey
WHEN c_custkey % 5 = 2 THEN c_nationkey || '|true' ELSE c_nationkey::VARCHAR END AS p1 FROM customer""", False)(
    lambda s, d: landing.landed(landed_bodies(s, d)).select("key", "state", F.concat_ws("|", landing.claim_texts(F.col("parsed"), "P1")).alias("p1"))
)
query("landed_states", f"SELECT state, count(*) AS n, count_if(state IN ('failed', 'malformed')) AS again FROM (SELECT {STATE} AS state FROM customer) GROUP BY 1", False)(lambda s, d: landing.states(landing.landed(landed_bodies(s, d))))


def landed_compounds(s: SparkSession, d: str) -> DataFrame:
    """key, http_status, body: a response a part, with its compound alone or in a list; the id is sometimes text."""
    k = F.col("p_partkey")
    one = F.concat(F.lit('{"CID": '), F.when(k % 4 == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(k.cast("string")), F.lit(', "SMILES": "'), F.col("p_brand"), F.lit('", "Title": '), F.when(k % 6 == 2, F.lit("null")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"'))), F.lit("}"))
    body = F.concat(F.lit('{"PropertyTable": {"Properties": '), F.when(k % 3 == 0, one).otherwise(F.concat(F.lit("["), one, F.lit("]"))), F.when(k % 10 == 7, F.lit("")).otherwise(F.lit("}}")))
    return _table(s, d, "part").select(k.alias("key"), F.when(k % 9 == 8, 404).otherwise(200).alias("http_status"), body.alias("body"))


query("landed_compounds", """SELECT p_partkey AS key, CASE WHEN p_partkey % 9 = 8 THEN 'empty' WHEN p_partkey % 10 = 7 THEN 'malformed' ELSE 'ok' END AS state, CASE WHEN state = 'ok' THEN p_partkey END AS id, CASE WHEN state = 'ok' THEN p_brand END AS payload,
CASE WHEN state = 'ok' AND p_partkey % 6 <> 2 THEN p_name END AS name FROM part""", False)(lambda s, d: landing.compounds(landing.landed(landed_compounds(s, d))))
query("keys_to_fetch", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)", False)(
    lambda s, d: artifacts.to_fetch(_table(s, d, "orders"), _table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, "ok").otherwise("failed").alias("status")), "o_custkey")
)
