"""Queries over entity mappings, split audits, samples and prompts, text vectors, edge scores and comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CELLS, V, cells, entity_vectors, label_counts, prepared, query, scored, splitted
from ..functions.shared import written
from ..operators import audits, checks, compare, edge_scores, edges, encoder, enrich, graph, history, linear, losses, mapping, metrics, prompts, reports, split, vectors
from .scores import EDGES, WINS, _hash, daily, frozen, linear_examples


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- mappings: suppliers as entities; some aren't found, some have no payload, some are there twice

MAP = """mp AS (SELECT 'SUP' || lpad(s_suppkey::VARCHAR, 9, '0') AS entity, CASE WHEN s_suppkey % 7 = 0 THEN 'not_found' WHEN s_suppkey % 11 = 0 THEN 'invalid' ELSE 'mapped' END AS status,
CASE WHEN s_suppkey % 17 = 0 THEN ' ' WHEN s_suppkey % 7 <> 0 THEN s_name END AS payload, s_nationkey AS key FROM supplier, range(CASE WHEN s_suppkey % 13 = 0 THEN 2 ELSE 1 END) WHERE s_suppkey % 19 <> 0)"""


def suppliers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(s, d, "supplier").where(k % 19 != 0).select(
        F.concat(F.lit("SUP"), F.lpad(k.cast("string"), 9, "0")).alias("entity"), F.when(k % 7 == 0, "not_found").when(k % 11 == 0, "invalid").otherwise("mapped").alias("status"),
        F.when(k % 17 == 0, " ").when(k % 7 != 0, F.col("s_name")).alias("payload"), F.col("s_nationkey").alias("key"), F.explode(F.sequence(F.lit(1), F.when(k % 13 == 0, 2).otherwise(1))).alias("_i"),
    ).drop("_i")


query("mapping_checks", f""", {MAP}, ends AS (SELECT e1 AS entity FROM pairs UNION SELECT e2 FROM pairs)
SELECT 'not_mapped' AS "check", count(*) AS n_bad FROM mp WHERE status <> 'mapped' UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM mp GROUP BY entity HAVING count(*) > 1)
UNION ALL SELECT 'no_payload', count(*) FROM mp WHERE trim(coalesce(payload, '')) = '' UNION ALL SELECT 'unknown_ends', count(*) FROM ends WHERE entity NOT IN (SELECT entity FROM mp)
UNION ALL SELECT 'repeated_pairs', count(*) - count(DISTINCT pair_id) FROM pairs""")(lambda s, d: mapping.mapping_checks(suppliers(s, d), prepared(s, d).pairs))
query("mapping_statuses", f"WITH {MAP} SELECT status, count(*) AS n FROM mp GROUP BY 1", False)(lambda s, d: mapping.value_counts(suppliers(s, d), "status"))
query("mapping_coverage", f"""WITH {MAP} SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT entity) FILTER (status = 'mapped') AS n_mapped,
round(100 * count(DISTINCT entity) FILTER (status = 'mapped') / count(DISTINCT entity)::DOUBLE, 2) AS mapped_pct, count(DISTINCT payload) FILTER (status = 'mapped') AS n_payloads, count(DISTINCT key) FILTER (status = 'mapped') AS n_keys FROM mp""", False)(
    lambda s, d: mapping.coverage(suppliers(s, d))
)
query("pair_eligibility", f""", {MAP}, ok AS (SELECT DISTINCT entity FROM mp WHERE status = 'mapped'), f AS (SELECT (e1 IN (SELECT entity FROM ok)) AND (e2 IN (SELECT entity FROM ok)) AS b FROM pairs)
SELECT count(*) AS n_pairs, count_if(b) AS both_mapped, count_if(NOT b) AS missing, round(100 * count_if(b)::DOUBLE / count(*), 2) AS pair_pct FROM f""")(lambda s, d: mapping.eligibility(prepared(s, d).pairs, suppliers(s, d)))
query("case_differences", "SELECT c_custkey FROM (SELECT c_custkey, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN ' ' || upper(c_name) ELSE c_name || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END END AS b FROM customer) WHERE lower(trim(a)) <> lower(trim(b))", False)(
    lambda s, d: mapping.case_differences(_table(s, d, "customer").select(
        "c_custkey", F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(""))).alias("b"),
    ), "a", "b").select("c_custkey")
)
query("same_keys", "SELECT unnest(['first_only', 'second_only']) AS \"check\", unnest([count_if(l_orderkey % 7 = 0), count_if(l_orderkey % 11 = 0 AND l_orderkey % 7 <> 0)]) AS n_bad FROM lineitem", False)(
    lambda s, d: (lambda t: checks.same_keys(t, t.where("l_orderkey % 7 <> 0").unionByName(t.where("l_orderkey % 11 = 0 AND l_orderkey % 7 <> 0")), ["l_orderkey", "l_linenumber"]))(_table(s, d, "lineitem"))
)

# ---- audits of splits

query("label_summary", """, b AS (SELECT pair_id, split FROM splits UNION ALL SELECT pair_id, 'all' FROM splits), pp AS (SELECT split, pair_id, count(label_index) AS k FROM b LEFT JOIN positives USING (pair_id) GROUP BY 1, 2),
pl AS (SELECT s.split, label_index, count(p.pair_id) AS k FROM (SELECT DISTINCT split FROM b) s CROSS JOIN kept LEFT JOIN (SELECT split, label_index, pair_id FROM b JOIN positives USING (pair_id)) p USING (split, label_index) GROUP BY 1, 2)
SELECT * FROM (SELECT split, count(*) AS n_pairs, sum(k)::BIGINT AS n_positives, round(avg(k), 4) AS labels_mean, quantile_cont(k, 0.5)::DOUBLE AS labels_median, min(k) AS labels_least, max(k) AS labels_most FROM pp GROUP BY 1)
JOIN (SELECT split, count_if(k > 0) AS with_positives, count_if(k = 0) AS without_positives, min(k) AS positives_least, quantile_cont(k, 0.5)::DOUBLE AS positives_median, max(k) AS positives_most FROM pl GROUP BY 1) USING (split)""")(
    lambda s, d: (lambda p, x: split.label_summary(x, p.positives, p.labels))(*splitted(s, d))
)
query("top_shifts", """, st AS (SELECT s.split, label_index, round(count(p.pair_id)::DOUBLE / any_value(s.n), 6) AS pv, any_value(k.n)::DOUBLE / (SELECT count(*) FROM pairs) AS fv
FROM (SELECT split, count(*) AS n FROM splits GROUP BY 1) s CROSS JOIN kept k LEFT JOIN (SELECT pair_id, label_index, split FROM positives JOIN splits USING (pair_id)) p USING (split, label_index) GROUP BY 1, 2)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY round(abs(pv - fv), 6) DESC, label_index) AS rank, label_index, round(abs(pv - fv), 6) AS shift FROM st QUALIFY rank <= 10""")(
    lambda s, d: (lambda p, x: split.top_shifts(split.label_stats(x, p.positives, p.labels), x, p.labels))(*splitted(s, d))
)
query("entity_relations", """, e AS (SELECT e, string_agg(split, '+' ORDER BY split) AS splits FROM (SELECT DISTINCT split, e1 AS e FROM splits UNION SELECT DISTINCT split, e2 FROM splits) GROUP BY 1)
SELECT splits, count(*) AS n_entities, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM e), 2) AS pct FROM e GROUP BY 1""")(lambda s, d: split.entity_relations(splitted(s, d)[1]))
query("top_labels", "SELECT label_id, n FROM freq ORDER BY n DESC, label_id LIMIT 20")(lambda s, d: label_counts(s, d).orderBy(F.desc("n"), "label_id").limit(20))

# ---- samples and prompts

PICK = lambda name, pos, neg, seed: f""", h{name} AS (SELECT pair_id, label_index, y, {_hash("pair_id || '-' || label_index", seed)} AS h, {_hash("pair_id || '-' || label_index", seed + 1)} AS o FROM edges),
q{name} AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, pair_id, label_index) AS r FROM h{name}), {name} AS (SELECT row_number() OVER (ORDER BY o, pair_id, label_index) - 1 AS sample_idx, pair_id, label_index, y FROM q{name} WHERE r <= CASE y WHEN 1 THEN {pos} ELSE {neg} END)"""  # noqa: E731


def sampled(s: SparkSession, d: str) -> DataFrame:
    return prompts.stratified(frozen(s, d), 200, 100)


query("stratified_sample", EDGES + PICK("sm", 200, 100, 17) + " SELECT * FROM sm")(sampled)
query("sample_by_split", EDGES + PICK("sm", 200, 100, 17) + " SELECT split, count(*) AS n FROM sm JOIN splits USING (pair_id) GROUP BY 1")(lambda s, d: prompts.by_split(sampled(s, d), splitted(s, d)[1]))


def shots(s: SparkSession, d: str) -> DataFrame:
    """Examples of training edges: supervised links, and negatives drawn for them."""
    p = prepared(s, d)
    links = graph.link_split(p.positives)
    return prompts.few_shot(edges.frozen_edges(links, p.positives, p.labels, "supervise"), p.pairs, p.labels)


SHOTS = EDGES.replace("role = 'test'", "role = 'supervise'") + PICK("fs", 3, 3, 19)
query("few_shot_examples", SHOTS + " SELECT row_number() OVER (ORDER BY y DESC, sample_idx) - 1 AS example, pair_id, label_index, y, e1 AS a, e2 AS b, label_name AS label FROM fs JOIN pairs USING (pair_id) JOIN kept USING (label_index)")(shots)
query("leakage", EDGES + PICK("sm", 200, 100, 17) + """ SELECT 'test_positives' AS "check", count(*) AS n_bad FROM held SEMI JOIN (SELECT * FROM links WHERE role NOT IN ('val', 'test')) USING (pair_id, label_index)
UNION ALL SELECT 'sampled_pairs', count(DISTINCT pair_id) FROM sm WHERE pair_id IN (SELECT pair_id FROM links WHERE role = 'supervise')""")(lambda s, d: leaks(s, d))


def leaks(s: SparkSession, d: str) -> DataFrame:
    """Test edges among the edges that degrees come from, which none may be, and sampled pairs that have supervised edges, which some do."""
    links = graph.link_split(prepared(s, d).positives)
    seen = links.where("role NOT IN ('val', 'test')")
    return checks.leakage(test_positives=(links.where("role = 'test'"), seen, ["pair_id", "label_index"]), sampled_pairs=(sampled(s, d), links.where("role = 'supervise'"), ["pair_id"]))


def by_digits(messages: list[list[tuple[str, str]]]) -> list[float]:
    """A scorer that needs no model: the last digit of the first entity over ten, so that the order of the pair counts."""
    return [int(m[-1][1].split("\n")[0][-1]) / 10 for m in messages]


def answers(s: SparkSession, d: str, swapped: bool = False) -> DataFrame:
    p = prepared(s, d)
    return prompts.ask(prompts.transcripts(sampled(s, d), p.pairs, p.labels, [("Is water wet?", 1)], "Answer Yes or No.", swapped), by_digits)


ANSWERS = EDGES + PICK("sm", 200, 100, 17) + ", an AS (SELECT sample_idx, pair_id, label_index, y, right(e1, 1)::INT / 10.0::DOUBLE AS p_yes, right(e2, 1)::INT / 10.0::DOUBLE AS q_yes FROM sm JOIN pairs USING (pair_id))"
query("prompt_answers", ANSWERS + " SELECT sample_idx, pair_id, label_index, y, p_yes, (p_yes >= 0.5)::INT AS predicted FROM an")(answers)
query("swapped_answers", ANSWERS + " SELECT round(avg(abs(p_yes - q_yes)), 6) AS mean_change, round(avg(((p_yes >= 0.5) <> (q_yes >= 0.5))::INT), 6) AS flipped, round(avg((round(abs(p_yes - q_yes), 9) > 0.1)::INT), 6) AS changed, count(*) AS n FROM an")(
    lambda s, d: (lambda a, b: reports.robustness(a.select("sample_idx", F.col("p_yes").alias("a")).join(b.select("sample_idx", F.col("p_yes").alias("b")), "sample_idx").select("a", F.round(F.col("b"), 9).alias("b")), change=0.1 + 1e-9))(answers(s, d), answers(s, d, True))
)
query("renamed_scores", """SELECT count(*) AS n, count_if(p_partkey % 4 = 0) AS renamed, round(avg(CASE WHEN p_partkey % 4 = 0 THEN 0.25 ELSE 0 END), 6) AS mean_change, count_if(p_partkey % 4 = 0 AND p_size % 10 BETWEEN 5 AND 7) AS flipped, count_if(p_partkey % 4 = 0) AS changed FROM part""", False)(
    lambda s, d: (lambda t: compare.renamed(t.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 10 / 10.0).alias("p")), t.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.lit("other")).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") % 10 / 10.0 - F.when(F.col("p_partkey") % 4 == 0, 0.25).otherwise(0.0)).alias("p"))))(_table(s, d, "part"))
)

# ---- text vectors and their audits

query("pooled_vectors", """WITH t AS (SELECT l_orderkey AS key, l_suppkey AS token, (l_linenumber % 3 <> 0)::INT AS mask FROM lineitem), n AS (SELECT key, sum(mask) AS n FROM t GROUP BY 1),
x AS (SELECT key, list_sum(embedding::DOUBLE[]) AS s FROM t JOIN embeddings ON vec_id = token WHERE mask = 1) SELECT key, round(sum(s) / greatest(any_value(n), 1), 4) + 0.0::DOUBLE AS total FROM x JOIN n USING (key) GROUP BY 1""", False)(
    lambda s, d: encoder.mean_pooled(
        _table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("token"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask")),
        _table(s, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("v")),
    ).groupBy("key").agg((F.round(F.sum("value"), 4) + 0.0).alias("total"))
)
query("token_audit", r"""WITH w AS (SELECT len(string_split_regex(text, '\s+'))::INT AS w FROM documents WHERE text IS NOT NULL)
SELECT min(w) AS least, quantile_cont(w, 0.5)::DOUBLE AS median, round(avg(w), 4) AS mean, max(w) AS most, count_if(w > 64) AS n_over, round(100 * count_if(w > 64)::DOUBLE / count(*), 2) AS over_pct FROM w""", False)(lambda s, d: encoder.token_audit(_table(s, d, "documents")))
query("vector_diagnostics", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS r FROM v), c AS (SELECT list_dot_product(a.v, b.v) / (a.r * b.r) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT round(avg(r), 6) AS norm_mean, round(stddev_pop(r), 6) AS norm_std, (SELECT round(avg(c), 6) FROM c) AS cosine_mean, (SELECT round(stddev_pop(c), 6) FROM c) AS cosine_std,
(SELECT count(*) FROM (SELECT 1 FROM v GROUP BY v HAVING count(*) > 1)) AS repeated_groups, count_if(r = 0) AS zero_vectors FROM n""", False)(lambda s, d: encoder.diagnostics(_table(s, d, "embeddings").select(F.col("embedding").alias("v"))))
query("value_histogram", "SELECT round(x::DOUBLE, 1) + 0.0::DOUBLE AS value, count(*) AS n FROM (SELECT unnest(embedding) AS x FROM embeddings) GROUP BY 1", False)(lambda s, d: encoder.histogram(_table(s, d, "embeddings").select(F.col("embedding").alias("v"))))
query("batch_losses", "WITH b AS (SELECT event_type, avg(value) AS l, count(value) AS n FROM events GROUP BY 1) SELECT round(sum(l * n) / sum(n), 6) AS weighted, round(avg(l), 6) AS of_batches FROM b", False)(
    lambda s, d: losses.mean_losses(_table(s, d, "events").select(F.col("event_type").alias("batch"), F.col("value").alias("loss")))
)

# ---- edges scored by vectors

EV = EDGES + f""", v AS ({V}), lv AS (SELECT vec_id AS label_index, embedding::DOUBLE[] AS l FROM embeddings),
es AS (SELECT f.y, a.v AS va, list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2])::FLOAT::DOUBLE) AS p, l FROM edges f JOIN pairs USING (pair_id) JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2 JOIN lv USING (label_index)),
ds AS (SELECT 'full' AS variant, y, list_dot_product(p, l) AS dot, sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(l, l)) AS np FROM es UNION ALL SELECT 'first_end', y, list_dot_product(va, l), sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(l, l)) FROM es),
lo AS (SELECT variant, y, unnest(['dot', 'norm_product', 'cosine']) AS scorer, unnest([round(dot, 6), round(np, 6), round(dot / np, 6)]) AS score FROM ds),
st AS (SELECT variant, scorer, score, sum(y) AS p, count(*) AS n FROM lo GROUP BY 1, 2, 3), rn AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY variant, scorer ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ab AS (SELECT variant, scorer, round(1 - sum(p * ((seen - tp) - (n - p) / 2.0::DOUBLE)) / (sum(p) * (sum(n) - sum(p)))::DOUBLE, 6) AS auroc, round(sum(p * tp / seen::DOUBLE) / sum(p), 6) AS auprc FROM rn GROUP BY 1, 2)"""


def label_vectors(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "embeddings").select(F.col("vec_id").alias("label_index"), F.col("embedding").alias("v"))


def vector_scores(s: SparkSession, d: str) -> DataFrame:
    e = frozen(s, d)
    return edge_scores.score_rows(edge_scores.pair_rows(edge_scores.with_ends(e, prepared(s, d).pairs, entity_vectors(s, d))), label_vectors(s, d), e)


def variants(s: SparkSession, d: str) -> DataFrame:
    """The same edges scored by the sum of both ends' vectors and by the first end's alone."""
    e = frozen(s, d)
    ends, lv = edge_scores.with_ends(e, prepared(s, d).pairs, entity_vectors(s, d)), label_vectors(s, d)
    first = ends.select("pair_id", "label_index", "y", F.col("va").alias("p"))
    return edge_scores.row_ablation(e, {"full": (edge_scores.pair_rows(ends), lv), "first_end": (first, lv)})


query("vector_aucs", EV + " SELECT scorer, auroc, auprc FROM ab WHERE variant = 'full'")(lambda s, d: edge_scores.aucs(vector_scores(s, d)))
query("feature_ablation", EV + " SELECT * FROM ab")(variants)
query("cosines_by_class", EV + " SELECT y, round(avg(dot / np), 6) AS mean_cosine, count(*) AS n FROM ds WHERE variant = 'full' GROUP BY 1")(lambda s, d: edge_scores.cosines_by_class(vector_scores(s, d)))
query("norm_baseline", f""", v AS ({V}), pv AS (SELECT list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2])::FLOAT::DOUBLE) AS v FROM pairs JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2)
SELECT 'pair' AS side, round(avg(sqrt(list_dot_product(v, v))), 4) AS mean, round(stddev_samp(sqrt(list_dot_product(v, v))), 4) AS std FROM pv UNION ALL SELECT 'label', round(avg(sqrt(list_dot_product(v, v))), 4), round(stddev_samp(sqrt(list_dot_product(v, v))), 4) FROM v""")(
    lambda s, d: edge_scores.norm_baseline(pair=vectors.pair_vectors(prepared(s, d).pairs, entity_vectors(s, d)), label=label_vectors(s, d))
)
query("count_fingerprints", """, w AS (SELECT DISTINCT 'SUP' || lpad(s_suppkey::VARCHAR, 9, '0') AS entity, (('0x' || substr(md5(unnest(['nation' || s_nationkey, 'tens' || s_suppkey // 10, 'rest' || s_suppkey % 7]) || ':42'), 1, 8))::BIGINT % 2048)::INT AS bit FROM supplier),
c AS (SELECT pair_id, bit, count(*) AS k FROM (SELECT pair_id, e1 AS entity FROM pairs UNION ALL SELECT pair_id, e2 FROM pairs) JOIN w USING (entity) GROUP BY 1, 2) SELECT pair_id, count_if(k = 1) AS ones, count_if(k = 2) AS twos, sum(bit)::BIGINT AS bit_sum FROM c GROUP BY 1""")(
    lambda s, d: (lambda e: edge_scores.count_fingerprint(prepared(s, d).pairs, e).groupBy("pair_id").agg(F.count_if(F.col("count") == 1).alias("ones"), F.count_if(F.col("count") == 2).alias("twos"), F.sum("bit").alias("bit_sum")))(
        _table(s, d, "supplier").select(
            F.concat(F.lit("SUP"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("entity"),
            vectors.hashed_set(F.concat(F.lit("nation"), "s_nationkey", F.lit(" tens"), F.floor(F.col("s_suppkey") / 10), F.lit(" rest"), F.col("s_suppkey") % 7)).alias("bits"),
        )
    )
)

# ---- comparisons and histories

query("label_comparison", WINS + """, pc AS (SELECT label_index, metric, max(v) FILTER (s = 'a') AS va, max(v) FILTER (s = 'b') AS vb FROM lm GROUP BY 1, 2),
pd_ AS (SELECT *, round(va - vb, 6) + 0.0::DOUBLE AS df, CASE WHEN va IS NULL OR vb IS NULL THEN NULL WHEN va - vb > 1e-12 THEN 'a' WHEN va - vb < -1e-12 THEN 'b' ELSE 'tie' END AS w FROM pc)
SELECT label_index, """ + ", ".join(f"max({c}) FILTER (metric = '{m}') AS {n}" for m in ("auroc", "auprc", "f1") for c, n in (("va", f"a_{m}"), ("vb", f"b_{m}"), ("df", f"{m}_diff"), ("w", f"{m}_winner"))) + " FROM pd_ GROUP BY 1")(
    lambda s, d: compare.label_comparison(*[metrics.per_label(scored(s, d, x)) for x in "ab"])
)
DAYS = "WITH h AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, round(avg(value), 4) AS metric FROM events GROUP BY 1, 2)"
query("run_sweep", DAYS + ", r AS (SELECT run, max(metric) AS best FROM h GROUP BY 1) SELECT count(*) AS n_runs, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS std, round(min(best), 6) AS least, round(max(best), 6) AS most FROM r", False)(
    lambda s, d: history.sweep(daily(s, d).groupBy("run").agg(F.max("metric").alias("best")), "best")
)


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """The best day of each run against the mean and deviation of its first hundred days."""
    h = daily(s, d)
    target = h.where("epoch < 100").groupBy(F.col("run").alias("metric")).agg(F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("std"))
    z = history.z_scores(h.groupBy(F.col("run").alias("metric")).agg(F.max("metric").alias("value")), target)
    return z.withColumn("verdict", history.verdict(F.col("z")))


query("verdicts", DAYS + """, t AS (SELECT run, avg(metric) AS m, stddev_pop(metric) AS s FROM h WHERE epoch < 100 GROUP BY 1), v AS (SELECT run AS metric, max(metric) AS value FROM h GROUP BY 1), z AS (SELECT metric, value, round((value - m) / nullif(s, 0), 6) AS z FROM v LEFT JOIN t ON run = metric)
SELECT *, CASE WHEN z IS NULL THEN 'undefined' WHEN abs(z) <= 1 THEN 'matches' WHEN abs(z) <= 2 THEN 'close' ELSE 'differs' END AS verdict FROM z""", False)(verdicts)
query("scores_beside_history", DAYS + ", c AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, count(*) AS n FROM events WHERE value > 0.5 GROUP BY 1, 2) SELECT h.run, h.epoch, round(metric, 6) AS metric, n FROM h LEFT JOIN c USING (run, epoch)", False)(
    lambda s, d: history.rounded(history.beside_training(daily(s, d), _table(s, d, "events").where("value > 0.5").groupBy(F.col("event_type").alias("run"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))), ["metric"])
)
query("synonym_lists", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name || '|' || p_brand END AS names, CASE WHEN p_type = p_brand THEN p_type ELSE array_to_string(list_sort([p_type, p_brand]), '|') END AS types FROM part""", False)(
    lambda s, d: (lambda t: t.select("p_partkey", F.size("l").alias("n"), F.concat_ws("|", "l").alias("names"), F.concat_ws("|", enrich.semantic_types(F.array("p_type", F.lit(" "), F.concat(F.lit(" "), "p_brand"), "p_type"))).alias("types")))(
        _table(s, d, "part").withColumn("l", enrich.synonyms(F.when(F.col("p_partkey") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(F.col("p_partkey").alias("CID"), F.array("p_name", "p_brand").alias("Synonym"))).alias("Information")).alias("InformationList")))))))
)


@query("linear_evaluation")
def linear_evaluation(s: SparkSession, d: str) -> DataFrame:
    """The linear scorer from start to end: trained on train pairs, threshold of the largest micro F1 on val pairs, metrics on test pairs. No SQL states a training."""
    rows, n, dims = linear_examples(s, d)
    w = linear.fit(linear.of_split(rows, "train"), n, dims)
    part = lambda name: linear.judged(linear.of_split(rows, name), w)
    t = metrics.best_threshold(part("val")).first()["t"] / 100
    return reports.aggregates(written(part("test")), t, distinct=True)


@query("linear_fit")
def linear_fit(s: SparkSession, d: str) -> DataFrame:
    """label_index, passes, loss, gradient_norm, converged of the training on train pairs. No SQL states a training."""
    rows, n, dims = linear_examples(s, d)
    end = linear.fitted(linear.of_split(rows, "train"), n, dims)
    cells = [(i, int(n), float(f), float(g), bool(g <= 1e-9)) for i, (n, f, g) in enumerate(zip(end.passes, end.loss, end.gradient))]
    return s.createDataFrame(cells, "label_index long, passes long, loss double, gradient_norm double, converged boolean")
