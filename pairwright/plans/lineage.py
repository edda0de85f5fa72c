"""Queries over message edges, lineage, stored vectors, states and examples, and scores through layers."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import LINKS, V, entity_vectors, n_labels, prepared, query
from ..functions.shared import dense_id, written
from ..operators import audits, clean, enrich, graph, linear, mapping, vectors
from ..sources.associations import associations
from .records import E, meta


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- message edges; for the checks some are planted where they don't belong

MESSAGES = LINKS + """, messages AS (SELECT 'train' AS split, pair_id, label_index FROM links WHERE role = 'message' UNION ALL SELECT 'val', pair_id, label_index FROM links WHERE role IN ('message', 'supervise')
UNION ALL SELECT 'test', pair_id, label_index FROM links WHERE role IN ('message', 'supervise', 'val'))"""


def broken_messages(links: DataFrame) -> DataFrame:
    """Test edges of every 97th pair as messages of test, val without those of every 89th pair, and edges that aren't there."""
    seen = graph.messages(links)
    own = links.where("role = 'test' AND pair_id % 97 = 3").select(F.lit("test").alias("split"), "pair_id", "label_index")
    alien = seen.where("split = 'test' AND pair_id % 83 = 2").withColumn("pair_id", -F.col("pair_id"))
    return seen.where("NOT (split = 'val' AND pair_id % 89 = 1)").unionByName(own).unionByName(alien)


query("message_edges", MESSAGES + " SELECT split, pair_id, label_index FROM messages")(lambda s, d: graph.messages(graph.link_split(prepared(s, d).positives)))
query("message_checks", MESSAGES + """, x AS (SELECT * FROM messages WHERE NOT (split = 'val' AND pair_id % 89 = 1) UNION ALL SELECT 'test', pair_id, label_index FROM links WHERE role = 'test' AND pair_id % 97 = 3
UNION ALL SELECT split, -pair_id, label_index FROM messages WHERE split = 'test' AND pair_id % 83 = 2)
SELECT 'leaked' AS "check", count(*) AS n_bad FROM (SELECT CASE role WHEN 'supervise' THEN 'train' ELSE role END AS split, pair_id, label_index FROM links WHERE role <> 'message') j SEMI JOIN x USING (split, pair_id, label_index)
UNION ALL SELECT 'not_nested', count(*) FROM (SELECT CASE split WHEN 'train' THEN 'val' ELSE 'test' END AS split, pair_id, label_index FROM x WHERE split <> 'test') j ANTI JOIN x USING (split, pair_id, label_index)
UNION ALL SELECT 'alien', count(*) FROM x ANTI JOIN links USING (pair_id, label_index)""")(lambda s, d: (lambda x: graph.message_checks(broken_messages(x), x))(graph.link_split(prepared(s, d).positives)))

# ---- lineage of edges and of stored vectors; some rows of what they are traced to are taken away or changed

query("edge_lineage", f""", v AS ({V})
SELECT p.pair_id, p.label_index, a.pair_id IS NOT NULL AS has_pair, k.label_index IS NOT NULL AS has_label, x.entity IS NOT NULL AND y.entity IS NOT NULL AS has_vectors, sha256(k.label_name) AS name_hash
FROM positives p LEFT JOIN (SELECT * FROM pairs WHERE pair_id % 101 <> 7) a USING (pair_id) LEFT JOIN (SELECT * FROM kept WHERE label_index % 9 <> 4) k ON k.label_index = p.label_index
LEFT JOIN (SELECT entity FROM v WHERE entity NOT LIKE '%3') x ON x.entity = a.e1 LEFT JOIN (SELECT entity FROM v WHERE entity NOT LIKE '%3') y ON y.entity = a.e2""")(
    lambda s, d: (lambda p: graph.edge_lineage(p.positives, p.pairs.where("pair_id % 101 <> 7"), p.labels.where("label_index % 9 <> 4"), entity_vectors(s, d).where("entity NOT LIKE '%3'")))(prepared(s, d))
)


def stored_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A vector table written and read again, its index and its source. Some ids are lacking, some there twice, some vectors doubled."""
    source = entity_vectors(s, d)
    index = written(dense_id(source.select("entity").distinct(), ["entity"], "id"))
    rows = index.join(source, "entity").where("id % 23 <> 1")
    rows = rows.withColumn("v", F.when(F.col("id") % 31 == 3, F.transform("v", lambda x: (x + x).cast("float"))).otherwise(F.col("v")))
    stored = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 29 == 2, 2).otherwise(1))).alias("_i")).drop("_i")
    return written(stored), index, source


query("stored_vectors", """WITH ix AS (SELECT row_number() OVER (ORDER BY e) - 1 AS id, e, v FROM (SELECT 'SUP' || lpad(vec_id::VARCHAR, 9, '0') AS e, embedding AS v FROM embeddings)),
st AS (SELECT id, CASE WHEN id % 31 = 3 THEN list_transform(v, lambda x: x + x) ELSE v END AS v FROM ix, range(CASE WHEN id % 29 = 2 THEN 2 ELSE 1 END) WHERE id % 23 <> 1)
SELECT 'missing' AS "check", count(*) AS n_bad FROM ix ANTI JOIN st USING (id) UNION ALL SELECT 'alien', count(*) FROM st ANTI JOIN ix USING (id) UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM st GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'different', count(*) FROM ix JOIN st USING (id) WHERE ix.v <> st.v UNION ALL SELECT 'gaps', max(id) + 1 - count(DISTINCT id) FROM st
UNION ALL SELECT 'length', count_if(len(v) <> (SELECT mode(len(v)) FROM st)) FROM st UNION ALL SELECT 'not_finite', count_if(len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0) FROM st
UNION ALL SELECT 'zero', count_if(len(list_filter(v, lambda x: x <> 0)) = 0) FROM st""", False)(lambda s, d: vectors.stored_checks(*stored_vectors(s, d)))
query("vector_domain", "SELECT 'domain' AS \"check\", count(*) AS n_bad FROM embeddings WHERE vec_id % 21 = 5 AND embedding[1] > 0", False)(
    lambda s, d: vectors.domain_check(_table(s, d, "embeddings").select(F.transform("embedding", lambda x, i: F.when(x <= 0, 0).when((F.col("vec_id") % 21 == 5) & (i == 0), 2).otherwise(1)).alias("v")), [0, 1])
)

# ---- states, classes and examples

query("status_ladder", """SELECT s_suppkey, CASE WHEN s_suppkey % 23 = 0 THEN 'invalid_format' WHEN s_suppkey % 7 = 0 THEN 'not_found' WHEN s_suppkey % 17 = 0 THEN 'missing_payload' WHEN s_suppkey % 11 = 0 THEN 'invalid' ELSE 'mapped' END AS status FROM supplier""", False)(
    lambda s, d: (lambda k: _table(s, d, "supplier").select("s_suppkey", mapping.status_ladder(
        F.concat(F.when(k % 23 == 0, "X").otherwise("S"), k.cast("string")), "^S[0-9]+$", F.when(k % 7 != 0, True), F.when(k % 17 == 0, " ").otherwise(F.col("s_name")), k % 11 != 0,
    ).alias("status")))(F.col("s_suppkey"))
)


def thinner(s: SparkSession, d: str) -> DataFrame:
    """The metadata rows without the aliases of every second and the description of every third entity."""
    k = F.substring("id", 2, 20).cast("long")
    return meta(s, d).withColumns({"n_aliases": F.when(k % 2 == 0, 0).otherwise(F.col("n_aliases")), "has_description": F.col("has_description") & (k % 3 != 0)})


query("richness", E + """, t AS (SELECT status, substr(id, 2)::BIGINT % 2 <> 0 AND n_aliases > 0 AS al, has_description AND substr(id, 2)::BIGINT % 3 <> 0 AS de FROM m),
c AS (SELECT unnest(['name', 'name+aliases', 'name+description', 'name+aliases+description']) AS class, unnest([false, true, false, true]) AS al, unnest([false, false, true, true]) AS de)
SELECT class, count(t.status) AS n, round(100 * count(t.status)::DOUBLE / (SELECT count(*) FROM m), 2) AS pct FROM c LEFT JOIN t ON t.al = c.al AND t.de = c.de AND t.status = 'found' GROUP BY 1""", False)(lambda s, d: enrich.richness(thinner(s, d)))
query("exceptions", E + "SELECT id, status FROM m WHERE status <> 'found'", False)(lambda s, d: enrich.exceptions(meta(s, d)))
query("id_examples", """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), k AS (SELECT 'malformed' AS kind, * FROM c WHERE NOT regexp_matches(value, '^Brand#[1-3][0-9]$') UNION ALL SELECT 'duplicate', * FROM c WHERE n > 1)
SELECT kind, value, n FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 10""", False)(lambda s, d: audits.id_examples(_table(s, d, "part"), "p_brand", "^Brand#[1-3][0-9]$"))


def renamed(s: SparkSession, d: str) -> DataFrame:
    """Associations in which some labels go by several names and some names by several labels."""
    a, i = associations(s, d), F.substring("entity_1", -1, 1)
    return a.withColumn("label_name", F.when(F.col("label_id").endswith("1"), F.concat("label_name", F.lit(" "), i)).when(F.col("label_id").endswith("2"), F.lit("several")).otherwise(F.col("label_name")))


query("conflict_examples", """, n AS (SELECT DISTINCT label_id, CASE WHEN label_id LIKE '%1' THEN label_name || ' ' || right(entity_1, 1) WHEN label_id LIKE '%2' THEN 'several' ELSE label_name END AS label_name FROM assoc),
b AS (SELECT 'id_to_names' AS "check", label_id AS key, label_name AS value FROM n UNION ALL SELECT 'name_to_ids', label_name, label_id FROM n),
k AS (SELECT "check", key FROM b GROUP BY 1, 2 HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY "check" ORDER BY key) <= 3),
v AS (SELECT * FROM b SEMI JOIN k USING ("check", key) QUALIFY row_number() OVER (PARTITION BY "check", key ORDER BY value) <= 3)
SELECT "check", key, string_agg(value, '|' ORDER BY value) AS values FROM v GROUP BY 1, 2""")(lambda s, d: clean.conflict_examples(renamed(s, d)).withColumn("values", F.concat_ws("|", "values")))

# ---- layers: weights from a rule, so that SQL can state them

PV = f""", v AS ({V}), pv AS (SELECT pair_id, list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2])::FLOAT::DOUBLE) AS v FROM pairs JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2)"""
HIDDEN = 6


def pair_vectors(s: SparkSession, d: str) -> DataFrame:
    return vectors.pair_vectors(prepared(s, d).pairs, entity_vectors(s, d))


def layered(s: SparkSession, d: str) -> DataFrame:
    v = pair_vectors(s, d)
    dims = entity_vectors(s, d).agg(F.max(F.size("v"))).first()[0] or 0  # of the vectors themselves: a first pair would take all of them to all pairs once more
    weights = lambda n, m, a, b, c, scale: ((np.arange(m + 1)[None] * a + np.arange(n)[:, None] * b) % c - c // 2) / scale
    return linear.forward(v, [weights(HIDDEN, dims, 7, 3, 11, 50), weights(n_labels(s, d), HIDDEN, 5, 2, 13, 10)])


query("layered_scores", PV + f""", i1 AS (SELECT pair_id, unnest(range(len(v) + 1)) AS i, unnest(v || [1.0::DOUBLE]) AS x FROM pv),
h AS (SELECT pair_id, j, sum(x * ((i * 7 + j * 3) % 11 - 5) / 50.0::DOUBLE) AS z FROM i1, range({HIDDEN}) r(j) GROUP BY 1, 2),
o AS (SELECT pair_id, k, sum(CASE WHEN z < 0 THEN 0.01::DOUBLE * z ELSE z END * ((j * 5 + k * 2) % 13 - 6) / 10.0::DOUBLE) + any_value((({HIDDEN} * 5 + k * 2) % 13 - 6) / 10.0::DOUBLE) AS z FROM h, (SELECT label_index AS k FROM kept) GROUP BY 1, 2)
SELECT pair_id, k AS label_index, round(1 / (1 + exp(-z)), 6) AS score FROM o""")(lambda s, d: layered(s, d).withColumn("score", F.round("score", 6)))


def layer(s: SparkSession, d: str) -> DataFrame:
    """Labels' neighbour sums and their own vectors (a one at the place label_index mod 8) by matrices of eight outputs."""
    p = prepared(s, d)
    sums = graph.neighbour_sum(p.positives, pair_vectors(s, d)).withColumnRenamed("label_index", "node")
    own = p.labels.select(F.col("label_index").alias("node"), (F.col("label_index") % 8).cast("int").alias("dim"), F.lit(1.0).alias("value"))
    outs = sums.select("dim").distinct().select("dim", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("out"))
    w = lambda a, m, scale: outs.select("dim", "out", (((F.col("dim") * a + F.col("out")) % m - m // 2) / scale).alias("w"))
    return graph.neighbour_layer(sums, own, w(1, 5, 4.0), w(3, 7, 5.0))


query("neighbour_layer", PV + """, lo AS (SELECT label_index, unnest(range(len(v))) AS dim, unnest(v) AS x FROM positives JOIN pv USING (pair_id)), sm AS (SELECT label_index AS node, dim, round(sum(x), 4) AS value FROM lo GROUP BY 1, 2),
z AS (SELECT node, o AS out, value * ((dim + o) % 5 - 2) / 4.0::DOUBLE AS value FROM sm, range(8) r(o) UNION ALL SELECT label_index, o, ((label_index % 8 * 3 + o) % 7 - 3) / 5.0::DOUBLE FROM kept, range(8) r(o))
SELECT node, out::INT AS out, round(sum(value), 6) AS value FROM z GROUP BY 1, 2""")(lambda s, d: layer(s, d).withColumn("value", F.round("value", 6)))
