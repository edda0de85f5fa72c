"""Queries that complete others: AP beside the areas, baselines exceeded, members of duplicate groups, whole profiles, stored scores, comparisons of runs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import LINKS, SC, cells, entity_vectors, n_labels, prepared, query, scored, splitted
from ..functions import blocks
from ..functions.shared import frame_path, written
from ..operators import audits, checks, compare, edge_scores, edges, encoder, enrich, graph, metrics, prompts, reports, vectors
from ..sources import associations
from .mappings import ANSWERS, EV, answers, sampled
from .records import named
from .reports import TWO
from .scores import EDGES, FLAT, frozen


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- edge metrics and baselines

AP50 = """, sk AS (SELECT pair_id, label_index, y, unnest(['pair_degree', 'label_degree', 'product', 'geometric', 'sum']) AS scorer, unnest([pd::DOUBLE, ld::DOUBLE, pd::DOUBLE * ld, round(sqrt(pd::DOUBLE * ld), 9), pd::DOUBLE + ld]) AS score FROM edges),
tk AS (SELECT scorer, y, row_number() OVER w AS r, sum(y) OVER w AS tp FROM sk WINDOW w AS (PARTITION BY scorer ORDER BY score DESC, pair_id, label_index ROWS UNBOUNDED PRECEDING)),
fa AS (SELECT scorer, round(coalesce(sum(CASE WHEN y = 1 THEN tp / r::DOUBLE ELSE 0 END) / nullif(sum(y), 0), 0), 6) AS ap_at_k FROM tk WHERE r <= 50 GROUP BY 1)"""
query("edge_metrics", EDGES + FLAT + AP50 + " SELECT scorer, auroc, auprc, ap_at_k FROM fm JOIN fa USING (scorer)")(lambda s, d: edges.edge_metrics(edges.structural_scores(frozen(s, d), keep=True)))


def beyond_baseline(s: SparkSession, d: str) -> DataFrame:
    """Vector scorers as runs, by their area, beside the best structural baseline on the same edges."""
    e, p = frozen(s, d), prepared(s, d)
    label = _table(s, d, "embeddings").select(F.col("vec_id").alias("label_index"), F.col("embedding").alias("v"))
    runs = edge_scores.aucs(edge_scores.score_rows(edge_scores.pair_rows(edge_scores.with_ends(e, p.pairs, entity_vectors(s, d))), label, e)).select(F.col("scorer").alias("run"), F.col("auroc").alias("metric"))
    return edges.beyond(runs, edges.best_baseline(edges.flat_metrics(edges.structural_scores(e))))


query("beyond_baseline", EV + FLAT.replace("sc AS", "sc2 AS").replace("FROM sc ", "FROM sc2 ").replace("st AS", "st2 AS").replace("FROM st ", "FROM st2 ").replace("rn AS", "rn2 AS").replace("FROM rn ", "FROM rn2 ")
      + ", be AS (SELECT scorer, auroc FROM fm ORDER BY auroc DESC, scorer LIMIT 1) SELECT ab.scorer AS run, ab.auroc AS metric, be.scorer AS scorer, be.auroc AS baseline, ab.auroc > be.auroc AS exceeds FROM ab, be WHERE variant = 'full'")(beyond_baseline)


def aggregated_ablation(s: SparkSession, d: str) -> DataFrame:
    """The same edges scored with label vectors of their own, of the sums over their training pairs, and of both, each variant after one round of neighbour sums."""
    p, e = prepared(s, d), frozen(s, d)
    v = entity_vectors(s, d)
    own = p.labels.select("label_index").join(_table(s, d, "embeddings").select(F.col("vec_id").alias("label_index"), F.col("embedding").cast("array<double>").alias("v")), "label_index")
    seen = graph.link_split(p.positives).where("role NOT IN ('val', 'test')")
    # edges find their ends, and vectors come to them; sums are a row a label
    near = vectors.both_ends(seen.select("pair_id", "label_index").join(p.pairs, "pair_id"), v)
    sums = written(blocks.vector_sums(near.select("label_index", vectors.summed("va", "vb").alias("v")), "label_index"))
    both = own.join(sums.withColumnRenamed("v", "s"), "label_index").select("label_index", F.zip_with("v", "s", lambda x, y: x + y).alias("v"))
    kept = lambda v: v.select("label_index", F.transform("v", lambda x: F.round(x, 6)).alias("v"))  # noqa: E731  so that the order of sums makes no ties
    rows = edge_scores.pair_rows(edge_scores.with_ends(e, p.pairs, v))
    got = edge_scores.row_ablation(e, {"own": (rows, own), "neighbours": (rows, kept(sums)), "both": (rows, kept(both))})
    return got.where("scorer = 'cosine'").select("variant", F.round("auroc", 4).alias("auroc"), F.round("auprc", 4).alias("auprc"))


query("aggregated_ablation", EDGES + """, v AS (SELECT 'SUP' || lpad(vec_id::VARCHAR, 9, '0') AS entity, embedding::DOUBLE[] AS v FROM embeddings), lv AS (SELECT label_index, embedding::DOUBLE[] AS l FROM kept JOIN embeddings ON vec_id = label_index),
pv AS (SELECT pair_id, list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2])::FLOAT::DOUBLE) AS p FROM pairs JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2),
se AS (SELECT label_index, dim, round(sum(x), 6) AS x, sum(x) AS raw FROM (SELECT label_index, unnest(range(len(p))) AS dim, unnest(p) AS x FROM links JOIN pv USING (pair_id) WHERE role NOT IN ('val', 'test')) GROUP BY 1, 2),
nv AS (SELECT label_index, list(x ORDER BY dim) AS l, list(raw ORDER BY dim) AS raw FROM se GROUP BY 1),
va AS (SELECT 'own' AS variant, label_index, l FROM lv UNION ALL SELECT 'neighbours', label_index, l FROM nv UNION ALL SELECT 'both', label_index, list_transform(list_zip(lv.l, raw), lambda x: round(x[1] + x[2], 6)) FROM lv JOIN nv USING (label_index)),
lo AS (SELECT variant, y, round(list_dot_product(p, l) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(l, l))), 6) AS score FROM edges JOIN pv USING (pair_id) JOIN va USING (label_index)),
st AS (SELECT variant, score, sum(y) AS p, count(*) AS n FROM lo GROUP BY 1, 2), rn AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY variant ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT variant, round(round(1 - sum(p * ((seen - tp) - (n - p) / 2.0::DOUBLE)) / (sum(p) * (sum(n) - sum(p)))::DOUBLE, 6), 4) AS auroc, round(round(sum(p * tp / seen::DOUBLE) / sum(p), 6), 4) AS auprc FROM rn GROUP BY 1""")(aggregated_ablation)

# ---- profiles and members

query("duplicate_members", """WITH l AS (SELECT p_partkey AS member, 'payload' AS attribute, p_brand || '-' || p_type AS value FROM part
UNION ALL SELECT p_partkey, 'name', CASE WHEN p_size <= 5 THEN 'SMILES:' || p_brand || '-' || p_type ELSE p_name END FROM part),
g AS (SELECT attribute, value, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) - 1 AS place FROM g)
SELECT attribute, place, value, n, member::BIGINT AS member FROM l JOIN r USING (attribute, value)""", False)(lambda s, d: enrich.duplicate_members(named(s, d), "id", ["payload", "name"]))
PROFILED = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string", "cents": "bigint"}
query("whole_profile", "WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal * 100)::BIGINT END AS cents FROM customer)" + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_null, round(100 * (count(*) - count({c}))::DOUBLE / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct, (SELECT {c}::VARCHAR FROM c ORDER BY c_custkey LIMIT 1) AS first FROM c" for c, t in PROFILED.items()
), False)(lambda s, d: audits.whole_profile(_table(s, d, "customer").withColumn("cents", F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("bigint"))).select(*PROFILED), "c_custkey"))
query("rows_per_pair", "SELECT count(*) AS n_keys, min(k) AS least, quantile_cont(k, 0.5)::DOUBLE AS median, round(avg(k), 6) AS mean, max(k) AS most FROM (SELECT count(*) AS k FROM assoc GROUP BY entity_1, entity_2)")(
    lambda s, d: audits.rows_per_key(associations.associations(s, d), ["entity_1", "entity_2"])
)
query("key_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS number FROM customer", False)(
    lambda s, d: _table(s, d, "customer").select("c_custkey", enrich.key_number(F.concat(F.when(F.col("c_custkey") % 4 == 0, "CID-").otherwise("CID"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("number"))
)
WORDS = r"len(string_split_regex(coalesce(text, ''), '\s+'))::BIGINT"
query("text_index", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id, sha256(coalesce(text, '')) AS hash, {WORDS} AS n_words, {WORDS} > 64 AS truncated FROM documents", False)(lambda s, d: encoder.text_index(_table(s, d, "documents"), "doc_id"))
query("over_limit", f"SELECT doc_id, {WORDS} AS n_words FROM documents WHERE {WORDS} > 64 AND text IS NOT NULL", False)(lambda s, d: encoder.over_limit(_table(s, d, "documents"), "doc_id"))
query("labels_of_first", "SELECT label_index, count(*) AS n_pos FROM positives WHERE pair_id IN (SELECT pair_id FROM splits WHERE split = 'train' ORDER BY pair_id LIMIT 2000) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda s, d: (lambda p, x: reports.labels_of_first(x.where("split = 'train'"), p.positives))(*splitted(s, d))
)
query("missing_tokens", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({x}) AS missing FROM customer" for c, x in (("c_name", "c_custkey % 6 < 3"), ("c_mktsegment", "false"))), False)(
    lambda s, d: (lambda t: t.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("c_name", "c_mktsegment")]).unpivot([], ["c_name", "c_mktsegment"], "column", "missing"))(
        associations.without_tokens(_table(s, d, "customer").select(F.when(F.col("c_custkey") % 6 == 0, "NA").when(F.col("c_custkey") % 6 == 1, "null").when(F.col("c_custkey") % 6 == 2, "").when(F.col("c_custkey") % 6 == 3, " NA").otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")))
)

# ---- stored scores and comparisons of runs


def stored_scores(s: SparkSession, d: str) -> DataFrame:
    """Both scorers' cells written by model into one table and read again."""
    path = frame_path(s)
    for m in "ab":
        associations.write_scored(scored(s, d, m), path, m)
    read = lambda m: associations.read_scored(s, path, m).select(F.lit(m).alias("model"), "*")
    return read("a").unionByName(read("b")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.round(F.avg("score"), 6).alias("mean"))


query("stored_scores", SC + " SELECT 'a' AS model, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(a), 6) AS mean FROM cells UNION ALL SELECT 'b', count(*), sum(y)::BIGINT, round(avg(b), 6) FROM cells")(stored_scores)
AP = """, rl AS (SELECT *, row_number() OVER (PARTITION BY label_index ORDER BY score DESC, pair_id) AS r FROM sc),
kk AS (SELECT k, label_index, score, sum(y) AS p, count(*) AS n FROM rl, (VALUES (20), (50)) t(k) WHERE r <= k GROUP BY 1, 2, 3), kr AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM kk WINDOW w AS (PARTITION BY k, label_index ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ka AS (SELECT k, label_index, round(coalesce(sum(p * tp / seen::DOUBLE) / nullif(sum(p), 0), 0), 6) AS ap FROM kr GROUP BY 1, 2)"""
query("ap_recomputed", SC + AP + ' SELECT label_index, max(ap) FILTER (k = 20) AS "old", max(ap) FILTER (k = 50) AS "new", round(max(ap) FILTER (k = 50) - max(ap) FILTER (k = 20), 6) + 0.0::DOUBLE AS change FROM ka GROUP BY 1')(
    lambda s, d: (lambda c: reports.beside_old(*[metrics.label_ap(c, k).select("label_index", F.round("ap", 6).alias("ap")) for k in (20, 50)], ["label_index"], "ap").withColumn("change", F.col("change") + 0.0))(scored(s, d))
)
query("definition_lists", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN 'a:' || p_brand ELSE array_to_string(list_sort(['a:' || p_brand, 'a:' || p_type, 'b:' || p_brand]), '|') END AS found FROM part", False)(
    lambda s, d: (lambda one: _table(s, d, "part").select("p_partkey", F.concat_ws("|", F.transform(enrich.definitions(F.array(one("b", F.col("p_brand")), one("a", F.concat(F.lit(" "), F.col("p_type"))), one("a", F.lit(" ")), one("a", F.col("p_brand")), one("a", F.col("p_brand")))), lambda x: F.concat(x["source"], F.lit(":"), x["value"]))).alias("found")))(lambda k, v: F.struct(F.lit(k).alias("source"), v.alias("value")))
)
query("release_tags", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'current' ELSE (2000 + p_size) || 'AB' END AS release FROM part", False)(
    lambda s, d: _table(s, d, "part").select("p_partkey", enrich.release(F.when(F.col("p_partkey") % 3 == 0, F.lit("/content/none")).otherwise(F.concat(F.lit("/content/"), (F.col("p_size") + 2000).cast("string"), F.lit("AB/x")))).alias("release"))
)
query("answers_in_order", ANSWERS + " SELECT sample_idx, pair_id, label_index, p_yes FROM an")(lambda s, d: prompts.in_sample_order(answers(s, d).select("pair_id", "label_index", "p_yes"), sampled(s, d)).select("sample_idx", "pair_id", "label_index", "p_yes"))


def run_fields(s: SparkSession, d: str, scorer: str) -> DataFrame:
    """One row of what a run was made with."""
    return scored(s, d, scorer).agg(F.lit("structural").alias("family"), F.lit(scorer).alias("scorer"), F.countDistinct("label_index").alias("n_labels"), F.countDistinct("pair_id").alias("n_pairs"), F.sum("y").alias("n_pos"), F.lit(None).cast("string").alias("note"))


query("comparable_runs", SC + """, x AS (SELECT count(DISTINCT label_index)::VARCHAR AS l, count(DISTINCT pair_id)::VARCHAR AS p, sum(y)::BIGINT::VARCHAR AS q FROM sc)
SELECT field, a, b, a IS NOT DISTINCT FROM b AS same FROM (SELECT unnest(['family', 'scorer', 'n_labels', 'n_pairs', 'n_pos', 'note']) AS field, unnest(['structural', 'a', l, p, q, NULL]) AS a, unnest(['structural', 'b', l, p, q, NULL]) AS b FROM x)""")(
    lambda s, d: checks.comparable(run_fields(s, d, "a"), run_fields(s, d, "b"), ["family", "scorer", "n_labels", "n_pairs", "n_pos", "note"])
)
query("scorer_widths", """, w AS (SELECT vec_id AS label_index, len(CASE WHEN vec_id % 7 = 0 THEN embedding[2:] ELSE embedding END) AS n FROM embeddings WHERE vec_id % 5 <> 1)
SELECT 'width' AS "check", count_if(n <> 64) AS n_bad FROM w UNION ALL SELECT 'no_weights', count(*) FROM kept WHERE label_index NOT IN (SELECT label_index FROM w) UNION ALL SELECT 'alien', count(*) FROM w WHERE label_index NOT IN (SELECT label_index FROM kept)""")(
    lambda s, d: checks.widths(_table(s, d, "embeddings").where("vec_id % 5 <> 1").select(F.col("vec_id").alias("label_index"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", F.lit(2), F.size("embedding") - 1)).otherwise(F.col("embedding")).alias("w")), 64, n_labels(s, d))
)
query("comparison_document", TWO + """, ro AS (SELECT metric, '{"metric":"' || metric || '","winner":"' || CASE WHEN a - b > 1e-12 THEN 'a' WHEN a - b < -1e-12 THEN 'b' ELSE 'tie' END || '"}' AS j FROM pv),
agr AS (SELECT count_if(a >= 0.5 AND b >= 0.5) AS p, count_if(a < 0.5 AND b < 0.5) AS n FROM cells) SELECT '{"metrics":[' || string_agg(j, ',' ORDER BY j) || '],"agreement":[{"both_pos":' || any_value(p) || ',"both_neg":' || any_value(n) || '}]}' AS document FROM ro, agr""")(
    lambda s, d: compare.document({"metrics": reports.metric_comparison(cells(s, d)).select("metric", "winner"), "agreement": compare.agreement(cells(s, d)).select("both_pos", "both_neg")})
)


def broken_links(links: DataFrame) -> DataFrame:
    """Links without every 47th pair, with a second role for every 53rd, and with pairs that are in no graph for every 59th."""
    i = F.col("pair_id")
    return links.where(i % 47 != 3).unionByName(links.where(i % 53 == 4).withColumn("role", F.lit("extra"))).unionByName(links.where(i % 59 == 5).withColumn("pair_id", -i - 1))


query("broken_link_contract", LINKS + """, b AS (SELECT * FROM links WHERE pair_id % 47 <> 3 UNION ALL SELECT pair_id, label_index, 'extra' FROM links WHERE pair_id % 53 = 4 UNION ALL SELECT -pair_id - 1, label_index, role FROM links WHERE pair_id % 59 = 5),
sh AS (SELECT avg((role = 'val')::INT) AS v, avg((role = 'test')::INT) AS t FROM b)
SELECT 'val_share' AS "check", (NOT (v > 0.1 AND v < 0.15))::BIGINT AS n_bad FROM sh UNION ALL SELECT 'test_share', (NOT (t > 0.1 AND t < 0.15))::BIGINT FROM sh
UNION ALL SELECT 'several_roles', count(*) FROM (SELECT 1 FROM b GROUP BY pair_id, label_index HAVING count(DISTINCT role) > 1)
UNION ALL SELECT 'alien', count(*) FROM (SELECT * FROM b ANTI JOIN positives USING (pair_id, label_index)) UNION ALL SELECT 'no_role', count(*) FROM (SELECT * FROM positives ANTI JOIN b USING (pair_id, label_index))""")(
    lambda s, d: (lambda p: audits.link_contract(broken_links(graph.link_split(p)), p, 0.1, 0.15))(prepared(s, d).positives)
)


def shuffled_orders(o: DataFrame) -> DataFrame:
    """Orders without every tenth, with keys of their own for every 31st, and with null for the status O."""
    k = F.col("o_orderkey")
    return o.where(k % 10 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))).withColumn("o_orderkey", F.when(k % 31 == 2, -k).otherwise(k))


query("aligned_both_ways", """WITH x AS (SELECT o_orderkey % 10 = 0 AS cut, o_orderkey % 31 = 2 AS own, o_orderstatus = 'O' AS o FROM orders)
SELECT unnest(['first_only', 'second_only', 'different']) AS "check", unnest([count_if(cut OR own), count_if(NOT cut AND own), count_if(NOT cut AND NOT own AND o)]) AS n_bad FROM x""", False)(
    lambda s, d: (lambda o: audits.aligned(o, shuffled_orders(o), "o_orderkey", ["o_orderstatus", "o_custkey"]))(_table(s, d, "orders"))
)
