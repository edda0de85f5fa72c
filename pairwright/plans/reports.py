"""Queries over reports, audits, losses and weights."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CELLS, LINKS, SC, STEPS, V, cells, entity_vectors, prepared, query, scored
from ..operators import audits, graph, losses, reports, vectors


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
query("table_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, round(100 * (count(*) - count({c}))::DOUBLE / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ORDERS
), False)(lambda s, d: audits.profile(_table(s, d, "orders").select(ORDERS)))
query("id_profile", r"""SELECT count(*) AS n_rows, count_if(trim(coalesce(p_brand, '')) = '') AS n_missing, count_if(regexp_matches(p_brand, '^Brand#([0-9]{2})$')) AS n_matched,
count_if(trim(p_brand) <> '' AND NOT regexp_matches(p_brand, '^Brand#([0-9]{2})$')) AS n_malformed, count(DISTINCT p_brand) AS n_distinct,
min(try_cast(regexp_extract(p_brand, '^Brand#([0-9]{2})$', 1) AS BIGINT)) AS least, max(try_cast(regexp_extract(p_brand, '^Brand#([0-9]{2})$', 1) AS BIGINT)) AS most FROM part""", False)(
    lambda s, d: audits.id_profile(_table(s, d, "part"), "p_brand", "^Brand#([0-9]{2})$")
)
def other_orders(o: DataFrame) -> DataFrame:
    """Orders without every tenth, with null for the status O, and every 21st twice."""
    some = o.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return some.unionByName(some.where("o_orderkey % 21 = 1"))


query("aligned_tables", """SELECT unnest(['first_only', 'second_only', 'different']) AS "check", unnest([count_if(o_orderkey % 10 = 0), 0, count_if(o_orderkey % 10 <> 0 AND (o_orderstatus = 'O' OR o_orderkey % 21 = 1))]) AS n_bad FROM orders""", False)(
    lambda s, d: (lambda o: audits.aligned(o, other_orders(o), "o_orderkey", ["o_orderstatus", "o_custkey"]))(_table(s, d, "orders"))
)
query("link_contract", LINKS + """, sh AS (SELECT avg((role = 'val')::INT) AS v, avg((role = 'test')::INT) AS t FROM links)
SELECT 'val_share' AS "check", (NOT (v > 0.05 AND v < 0.15))::BIGINT AS n_bad FROM sh UNION ALL SELECT 'test_share', (NOT (t > 0.05 AND t < 0.15))::BIGINT FROM sh
UNION ALL SELECT 'several_roles', count(*) FROM (SELECT 1 FROM links GROUP BY pair_id, label_index HAVING count(DISTINCT role) > 1)
UNION ALL SELECT 'alien', count(*) FROM (SELECT * FROM links ANTI JOIN positives USING (pair_id, label_index)) UNION ALL SELECT 'no_role', count(*) FROM (SELECT * FROM positives ANTI JOIN links USING (pair_id, label_index))""")(
    lambda s, d: (lambda p: audits.link_contract(graph.link_split(p), p))(prepared(s, d).positives)
)
query("common_names", r"""WITH n AS (SELECT p_partkey, unnest([p_type || '-' || p_size || '-' || p_size, 'DB' || p_partkey, lower(p_type), p_name, '[' || p_name || ']', p_partkey || '-1-2']) AS x, unnest(range(6)) AS i FROM part),
k AS (SELECT * FROM n WHERE length(x) BETWEEN 1 AND 40 AND length(regexp_replace(x, '[^\p{L}]', '', 'g'))::DOUBLE / length(x) >= 0.7 AND NOT regexp_matches(x, '^\d+-\d+-\d+$|(?i)^DB\d+$|^\d+$|[\[\]{}]|\d.*-.*\d'))
SELECT p_partkey, arg_min(k.x, length(k.x) * 10 + k.i) AS name FROM n LEFT JOIN k USING (p_partkey, i) GROUP BY 1""", False)(
    lambda s, d: _table(s, d, "part").select("p_partkey", audits.common_name(F.array(
        F.concat_ws("-", "p_type", "p_size", "p_size"), F.concat(F.lit("DB"), F.col("p_partkey").cast("string")), F.lower("p_type"), F.col("p_name"), F.concat(F.lit("["), "p_name", F.lit("]")), F.concat(F.col("p_partkey").cast("string"), F.lit("-1-2")),
    )).alias("name"))
)
query("question_texts", " SELECT pair_id, label_index, 'A: ' || e1 || chr(10) || 'B: ' || e2 || chr(10) || 'Label: ' || label_name || chr(10) || 'Question: do A and B together have the label ' || label_name || '?' || chr(10) || 'Answer:' AS question FROM positives JOIN pairs USING (pair_id) JOIN kept USING (label_index)")(
    lambda s, d: (lambda p: p.positives.join(p.pairs, "pair_id").join(p.labels, "label_index").select("pair_id", "label_index", audits.question(F.col("e1"), F.col("e2"), F.col("label_name")).alias("question")))(prepared(s, d))
)


def label_losses(s: SparkSession, d: str) -> DataFrame:
    x, y = 4 * F.col("score") - 2, F.col("y")
    return scored(s, d).groupBy("label_index").agg(
        F.round(F.avg(losses.cross_entropy(x, y)), 6).alias("cross_entropy"), F.round(F.avg(losses.focal(x, y)), 6).alias("focal"), F.round(F.avg(losses.focal(x, y, 1.5, -1, 0.1)), 6).alias("smoothed")
    )


query("label_losses", SC + """, x AS (SELECT label_index, 4 * score - 2 AS x, y::DOUBLE AS y, y * 0.9::DOUBLE + 0.05::DOUBLE AS z, 1 / (1 + exp(-(4 * score - 2))) AS p FROM sc),
l AS (SELECT *, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS ce, greatest(x, 0) - x * z + ln(1 + exp(-abs(x))) AS cz FROM x)
SELECT label_index, round(avg(ce), 6) AS cross_entropy, round(avg(ce * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * (0.25 * y + 0.75 * (1 - y))), 6) AS focal, round(avg(cz * pow(1 - (p * z + (1 - p) * (1 - z)), 1.5)), 6) AS smoothed FROM l GROUP BY 1""")(label_losses)


def decayed_means(s: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type, an event weighing less by the week of its age at the start."""
    w = losses.decay(F.datediff("ts", F.lit("2024-01-01")), 1.0, 7, 0.96)
    return _table(s, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("weighted_mean"), F.round(F.avg("value"), 6).alias("mean"))


query("decayed_means", """WITH e AS (SELECT event_type, value, pow(0.96::DOUBLE, floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7.0::DOUBLE)) AS w FROM events)
SELECT event_type, round(sum(value * w) / sum(w), 6) AS weighted_mean, round(avg(value), 6) AS mean FROM e GROUP BY 1""", False)(decayed_means)
query("yes_shares", """WITH v AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS a, embedding[5:8]::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, round(1 / (1 + list_sum(list_transform(b, lambda x: exp(x))) / list_sum(list_transform(a, lambda x: exp(x)))), 6) AS p_yes FROM v""", False)(
    lambda s, d: (lambda v: _table(s, d, "embeddings").select("vec_id", F.round(losses.yes_share(F.slice(v, 1, 4), F.slice(v, 5, 4)), 6).alias("p_yes")))(F.col("embedding").cast("array<double>"))
)
query("label_report", SC + STEPS + ", n AS (SELECT label_index, sum(y)::BIGINT AS n_pos, round(avg(y), 6) AS prevalence FROM sc GROUP BY 1) SELECT label_index, label_id, label_name, n_pos, prevalence, auroc, auprc, f1 FROM kept JOIN n USING (label_index) JOIN lab USING (label_index)")(
    lambda s, d: reports.label_report(scored(s, d), prepared(s, d).labels)
)
TWO = CELLS + """, sc AS (SELECT 'a' AS s, pair_id, label_index, y, a AS score FROM cells UNION ALL SELECT 'b', pair_id, label_index, y, b FROM cells),
steps AS (SELECT s, label_index, score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2, 3),
run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM steps WINDOW w AS (PARTITION BY s, label_index ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ag AS (SELECT s, label_index, sum(p) AS P1, sum(n) AS A1, sum(p * tp / seen::DOUBLE) AS ap, sum(p * ((seen - tp) - (n - p) / 2.0::DOUBLE)) AS above, sum(CASE WHEN score >= 0.5 THEN p ELSE 0 END) AS hit, sum(CASE WHEN score >= 0.5 THEN n ELSE 0 END) AS said FROM run GROUP BY 1, 2),
lab AS (SELECT s, label_index, round(CASE WHEN P1 > 0 AND A1 > P1 THEN 1 - above / (P1 * (A1 - P1))::DOUBLE END, 6) AS auroc, round(CASE WHEN P1 > 0 THEN ap / P1 END, 6) AS auprc, round(CASE WHEN said + P1 > 0 THEN 2 * hit::DOUBLE / (said + P1) END, 6) AS f1, hit, said, P1 FROM ag),
gl AS (SELECT s, score, sum(p) AS p, sum(n) AS n FROM steps GROUP BY 1, 2), gr AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM gl WINDOW w AS (PARTITION BY s ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
rp AS (SELECT *, row_number() OVER w AS r, sum(y) OVER w AS tp FROM sc WINDOW w AS (PARTITION BY s, pair_id ORDER BY score DESC, label_index ROWS UNBOUNDED PRECEDING)),
pp AS (SELECT s, sum(CASE WHEN r <= 50 AND y = 1 THEN tp / r::DOUBLE ELSE 0 END) / least(nullif(sum(y), 0), 50) AS ap FROM rp GROUP BY s, pair_id),
rl AS (SELECT *, row_number() OVER (PARTITION BY s, label_index ORDER BY score DESC, pair_id) AS r FROM sc),
ks AS (SELECT s, label_index, score, sum(y) AS p, count(*) AS n FROM rl WHERE r <= 50 GROUP BY 1, 2, 3),
kr AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM ks WINDOW w AS (PARTITION BY s, label_index ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pl AS (SELECT s, label_index, coalesce(sum(p * tp / seen::DOUBLE) / nullif(sum(p), 0), 0) AS ap FROM kr GROUP BY 1, 2),
rf AS (SELECT *, row_number() OVER w AS r, sum(y) OVER w AS tp FROM sc WINDOW w AS (PARTITION BY s ORDER BY score DESC, pair_id, label_index ROWS UNBOUNDED PRECEDING)),
al AS (SELECT s, 'macro_auroc' AS metric, round(avg(auroc), 6) AS v FROM lab GROUP BY 1 UNION ALL SELECT s, 'macro_auprc', round(avg(auprc), 6) FROM lab GROUP BY 1 UNION ALL SELECT s, 'macro_f1', round(avg(f1), 6) FROM lab GROUP BY 1
UNION ALL SELECT s, 'micro_f1', round(2 * sum(hit)::DOUBLE / sum(said + P1), 6) FROM lab GROUP BY 1 UNION ALL SELECT s, 'micro_auprc', round(sum(p * tp / seen::DOUBLE) / sum(p), 6) FROM gr GROUP BY 1
UNION ALL SELECT s, 'pair_ap', round(avg(coalesce(ap, 0)), 6) FROM pp GROUP BY 1 UNION ALL SELECT s, 'label_ap', round(avg(ap), 6) FROM pl GROUP BY 1
UNION ALL SELECT s, 'flat_ap', round(coalesce(sum(CASE WHEN y = 1 THEN tp / r::DOUBLE ELSE 0 END) / nullif(sum(y), 0), 0), 6) FROM rf WHERE r <= 50 GROUP BY 1),
pv AS (SELECT metric, max(v) FILTER (s = 'a') AS a, max(v) FILTER (s = 'b') AS b FROM al GROUP BY 1)"""
query("evaluation_row", TWO + " SELECT metric, a AS value FROM pv")(lambda s, d: reports.aggregates(scored(s, d)))
query("metric_comparison", TWO + " SELECT metric, a, b, round(a - b, 5) AS diff, round(100 * (a - b) / nullif(b, 0), 2) AS relative_pct, CASE WHEN a - b > 1e-12 THEN 'a' WHEN a - b < -1e-12 THEN 'b' ELSE 'tie' END AS winner FROM pv")(lambda s, d: reports.metric_comparison(cells(s, d)))
query("example_predictions", SC + """, f AS (SELECT DISTINCT pair_id FROM sc ORDER BY pair_id LIMIT 20), rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, label_index) AS rank FROM sc JOIN f USING (pair_id))
SELECT pair_id, rank, label_id, label_name, y FROM rk JOIN kept USING (label_index) WHERE rank <= 10""")(lambda s, d: reports.examples(scored(s, d), prepared(s, d).labels))
query("ap_summary", TWO + " SELECT round(min(ap), 5) AS least, round(median(ap), 5) AS median, round(avg(ap), 5) AS mean, round(max(ap), 5) AS most, count(*) AS n_labels FROM pl WHERE s = 'a'")(lambda s, d: reports.ap_summary(scored(s, d)))
query("robustness", CELLS + " SELECT round(avg(abs(a - b)), 6) AS mean_change, round(avg(((a >= 0.5) <> (b >= 0.5))::INT), 6) AS flipped, round(avg((abs(a - b) > 0.1)::INT), 6) AS changed, count(*) AS n FROM cells")(lambda s, d: reports.robustness(cells(s, d)))


def symmetry(s: SparkSession, d: str) -> DataFrame:
    """Largest difference between a pair's vector and that of the pair turned round, for the sum and, to see one, for the difference of both ends."""
    pairs, v = prepared(s, d).pairs, entity_vectors(s, d)
    both = vectors.both_ends(pairs, v)
    gap = lambda f: F.max(F.array_max(F.zip_with(f(F.col("va"), F.col("vb")), f(F.col("vb"), F.col("va")), lambda x, y: F.abs(x - y))))
    add, take = (lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") + y)), (lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") - y))
    even = vectors.order_free(take, F.col("va"), F.col("vb"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(gap(add), 6).alias("sum_gap"), F.round(gap(take), 6).alias("difference_gap"), F.round(F.max(F.array_max(F.transform(even, F.abs))), 6).alias("order_free"))


query("pair_symmetry", f""", v AS ({V}), j AS (SELECT a.v AS va, b.v AS vb FROM pairs JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2),
g AS (SELECT list_max(list_transform(list_zip(va, vb), lambda x: abs((x[1] + x[2]) - (x[2] + x[1])))) AS s, list_max(list_transform(list_zip(va, vb), lambda x: abs(2 * (x[1] - x[2])))) AS t,
list_max(list_transform(list_zip(va, vb), lambda x: abs(((x[1] - x[2]) + (x[2] - x[1])) / 2))) AS u FROM j)
SELECT count(*) AS n, round(max(s), 6) AS sum_gap, round(max(t), 6) AS difference_gap, round(max(u), 6) AS order_free FROM g""")(symmetry)
