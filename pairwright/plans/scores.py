"""Queries over scored tables, sampled edges, metric histories and trained scorers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CELLS, LINKS, V, cells, entity_vectors, n_labels, prepared, query, scored, shared_frame, splitted, stored_splits
from ..operators import bootstrap, compare, edges, graph, history, linear, metrics, ranks, vectors


def frozen(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    return edges.frozen_edges(graph.link_split(p.positives), p.positives, p.labels)


def _hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT"


EDGES = LINKS + f""", held AS (SELECT pair_id, label_index FROM links WHERE role = 'test'),
drawn AS (SELECT DISTINCT pair_id, {_hash("pair_id || '-' || label_index || '-' || i", 11)} % (SELECT count(*) FROM kept) AS label_index FROM held CROSS JOIN range(2) t(i)),
free AS (SELECT * FROM drawn ANTI JOIN positives USING (pair_id, label_index)),
neg AS (SELECT * FROM free QUALIFY row_number() OVER (ORDER BY {_hash("pair_id || '-' || label_index", 12)}, pair_id, label_index) <= (SELECT count(*) FROM held)),
p_ AS (SELECT pair_id, count(*) AS pd FROM links WHERE role NOT IN ('val', 'test') GROUP BY 1), l_ AS (SELECT label_index, count(*) AS ld FROM links WHERE role NOT IN ('val', 'test') GROUP BY 1),
edges AS (SELECT pair_id, label_index, y, coalesce(pd, 0) AS pd, coalesce(ld, 0) AS ld FROM (SELECT *, 1 AS y FROM held UNION ALL SELECT *, 0 FROM neg) LEFT JOIN p_ USING (pair_id) LEFT JOIN l_ USING (label_index))"""
FLAT = """, sc AS (SELECT y, unnest(['pair_degree', 'label_degree', 'product', 'geometric', 'sum']) AS scorer, unnest([pd::DOUBLE, ld::DOUBLE, pd::DOUBLE * ld, round(sqrt(pd::DOUBLE * ld), 9), pd::DOUBLE + ld]) AS score FROM edges),
st AS (SELECT scorer, score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2),
rn AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY scorer ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
fm AS (SELECT scorer, round(1 - sum(p * ((seen - tp) - (n - p) / 2.0::DOUBLE)) / (sum(p) * (sum(n) - sum(p)))::DOUBLE, 6) AS auroc, round(sum(p * tp / seen::DOUBLE) / sum(p), 6) AS auprc FROM rn GROUP BY 1)"""
query("frozen_edges", EDGES + " SELECT pair_id, label_index, y, pd, ld FROM edges")(frozen)
query("edge_baselines", EDGES + FLAT + " SELECT * FROM fm")(lambda s, d: edges.flat_metrics(edges.structural_scores(frozen(s, d))))
query("best_baseline", EDGES + FLAT + " SELECT scorer, auroc FROM fm ORDER BY auroc DESC, scorer LIMIT 1")(lambda s, d: edges.best_baseline(edges.flat_metrics(edges.structural_scores(frozen(s, d)))))
query("degrees_by_class", EDGES + """, lo AS (SELECT y, 'pd' AS feature, pd AS x FROM edges UNION ALL SELECT y, 'ld', ld FROM edges)
SELECT feature, y, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6)::DOUBLE AS median, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.25), 6)::DOUBLE AS p25, round(quantile_cont(x, 0.75), 6)::DOUBLE AS p75 FROM lo GROUP BY 1, 2""")(
    lambda s, d: edges.by_class(frozen(s, d), ["pd", "ld"])
)
query("sampled_hops", f""", e AS (SELECT 'p' || pair_id AS a, 'l' || label_index AS b FROM positives), es AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
h1 AS (SELECT src, dst FROM es WHERE src IN (SELECT 'p' || pair_id FROM splits WHERE split = 'test') QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_hash("src || '-' || dst", 3)}, dst) <= 20),
h2 AS (SELECT src, dst FROM es WHERE src IN (SELECT dst FROM h1) QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_hash("src || '-' || dst", 4)}, dst) <= 10)
SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2""")(lambda s, d: hop_sample(s, d))


def hop_sample(s: SparkSession, d: str) -> DataFrame:
    p, x = splitted(s, d)
    ends = p.positives.select(F.concat(F.lit("p"), F.col("pair_id").cast("string")).alias("src"), F.concat(F.lit("l"), F.col("label_index").cast("string")).alias("dst"))
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.sampled_hops(x.where("split = 'test'").select(F.concat(F.lit("p"), F.col("pair_id").cast("string")).alias("node")), both, [20, 10])


SAMPLED = f", dr AS (SELECT a, b FROM cells ORDER BY {_hash("pair_id || '-' || label_index", 23)}, pair_id, label_index LIMIT 100000)"
query("spearman", CELLS + SAMPLED + """, rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM dr),
r AS (SELECT corr(ra, rb) AS r, count(*) AS n FROM rk) SELECT round(r, 6) AS spearman, round(r * sqrt((n - 2) / (1 - r * r)), 2) AS t, n FROM r""")(lambda s, d: ranks.spearman(cells(s, d)))
query("rank_differences", """, p_ AS (SELECT pair_id, count(*) AS a, sum(label_index) AS b FROM positives GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY a DESC, pair_id) AS ra, row_number() OVER (ORDER BY b DESC, pair_id) AS rb FROM p_) SELECT count(*) AS n, count_if(ra <> rb) AS n_different FROM r""")(
    lambda s, d: ranks.rank_differences(prepared(s, d).positives.groupBy("pair_id").agg(F.count(F.lit(1)).alias("a"), F.sum("label_index").alias("b")), "a", "b", "pair_id")
)
query("evenly_spaced", "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r IN (SELECT i * (n - 1) // 14 FROM range(15) t(i))", False)(
    lambda s, d: ranks.evenly_spaced(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name"), "c_custkey", 15)
)
REPS = 500
query("paired_bootstrap", CELLS + f""", tn AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS r, count(*) OVER () AS n FROM pd),
ws AS (SELECT rep, t.pair_id, count(*) AS w FROM (SELECT rep, ('0x' || substr(md5((rep * n + r)::VARCHAR || ':13'), 1, 12))::BIGINT % n AS r FROM tn CROSS JOIN range({REPS}) g(rep)) JOIN tn t USING (r) GROUP BY 1, 2),
lo AS (SELECT pair_id, label_index, y, 'a' AS s, a AS score FROM cells UNION ALL SELECT pair_id, label_index, y, 'b', b FROM cells),
rk AS (SELECT *, row_number() OVER w AS r, sum(y) OVER w AS tp FROM lo WINDOW w AS (PARTITION BY s, pair_id ORDER BY score DESC, label_index ROWS UNBOUNDED PRECEDING)),
per AS (SELECT s, pair_id, sum(y) AS p, sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS hit, count_if(score >= 0.5) AS said, sum(CASE WHEN r <= 50 AND y = 1 THEN tp / r::DOUBLE ELSE 0 END) AS ap FROM rk GROUP BY 1, 2),
fl AS (SELECT rep, s, 2 * sum(w * hit)::DOUBLE / sum(w * (said + p)) AS f1, sum(w * CASE WHEN p > 0 THEN ap / least(p, 50) ELSE 0 END) / sum(w) AS ap FROM per JOIN ws USING (pair_id) GROUP BY 1, 2),
st AS (SELECT rep, s, label_index, score, sum(w * y) AS p, sum(w) AS n FROM lo JOIN ws USING (pair_id) GROUP BY 1, 2, 3, 4),
rn AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY rep, s, label_index ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
la AS (SELECT rep, s, label_index, sum(p * tp::DOUBLE / seen) / sum(p) AS v FROM rn GROUP BY 1, 2, 3 HAVING sum(p) > 0), ma AS (SELECT rep, s, avg(v) AS v FROM la GROUP BY 1, 2),
al AS (SELECT rep, s, 'micro_f1' AS metric, f1 AS v FROM fl UNION ALL SELECT rep, s, 'ap_at_k', ap FROM fl UNION ALL SELECT rep, s, 'macro_auprc', v FROM ma),
df AS (SELECT rep, metric, max(v) FILTER (s = 'a') - max(v) FILTER (s = 'b') AS d FROM al GROUP BY 1, 2)
SELECT metric, round(avg(d), 6) + 0.0::DOUBLE AS mean, round(quantile_cont(d, 0.025), 6) + 0.0::DOUBLE AS low, round(quantile_cont(d, 0.975), 6) + 0.0::DOUBLE AS high, count_if(round(d, 9) > 0) AS a_ahead, count_if(round(d, 9) < 0) AS b_ahead, round((count_if(round(d, 9) <= 0) + 1) / (count(*) + 1), 6) AS p FROM df GROUP BY 1""")(
    lambda s, d: bootstrap.summary(bootstrap.paired(cells(s, d), REPS))
)
WINS = CELLS + """, sc AS (SELECT 'a' AS s, label_index, y, a AS score FROM cells UNION ALL SELECT 'b', label_index, y, b FROM cells),
steps AS (SELECT s, label_index, score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2, 3),
run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM steps WINDOW w AS (PARTITION BY s, label_index ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ag AS (SELECT s, label_index, sum(p) AS P1, sum(n) AS A1, sum(p * tp / seen::DOUBLE) AS ap, sum(p * ((seen - tp) - (n - p) / 2.0::DOUBLE)) AS above, sum(CASE WHEN score >= 0.5 THEN p ELSE 0 END) AS hit, sum(CASE WHEN score >= 0.5 THEN n ELSE 0 END) AS said FROM run GROUP BY 1, 2),
lm AS (SELECT s, label_index, unnest(['auroc', 'auprc', 'f1']) AS metric, unnest([round(CASE WHEN P1 > 0 AND A1 > P1 THEN 1 - above / (P1 * (A1 - P1))::DOUBLE END, 6), round(CASE WHEN P1 > 0 THEN ap / P1 END, 6), round(CASE WHEN said + P1 > 0 THEN 2 * hit::DOUBLE / (said + P1) END, 6)]) AS v FROM ag),
pv AS (SELECT label_index, metric, max(v) FILTER (s = 'a') AS va, max(v) FILTER (s = 'b') AS vb FROM lm GROUP BY 1, 2),
pw AS (SELECT *, CASE WHEN va - vb > 1e-12 THEN 'a' WHEN va - vb < -1e-12 THEN 'b' ELSE 'tie' END AS winner FROM pv WHERE va IS NOT NULL AND vb IS NOT NULL)"""
query("label_wins", WINS + " SELECT metric, winner, count(*) AS n FROM pw GROUP BY 1, 2")(lambda s, d: (lambda c: compare.label_wins(*[metrics.per_label(c.select("pair_id", "label_index", "y", F.col(x).alias("score"))) for x in "ab"]))(cells(s, d)))


def daily(s: SparkSession, d: str) -> DataFrame:
    """run, epoch, metric: mean value of each event type by day."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", "value", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("epoch"))
    return e.groupBy(F.col("event_type").alias("run"), "epoch").agg(F.round(F.avg("value"), 4).alias("metric"))


H = "WITH RECURSIVE h AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, round(avg(value), 4) AS metric FROM events GROUP BY 1, 2)"
query("patience", H + """, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM h),
r AS (SELECT run, i, epoch, metric AS best, epoch AS best_epoch, 0 AS missed FROM k WHERE i = 1
UNION ALL SELECT k.run, k.i, k.epoch, CASE WHEN metric > best + 0.05 THEN metric ELSE best END, CASE WHEN metric > best + 0.05 THEN k.epoch ELSE best_epoch END, CASE WHEN metric > best + 0.05 THEN 0 ELSE missed + 1 END
FROM r JOIN k ON k.run = r.run AND k.i = r.i + 1 WHERE missed < 5)
SELECT run, best_epoch, best, CASE WHEN missed >= 5 THEN epoch END AS stop_epoch FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1""", False)(lambda s, d: history.patience(daily(s, d), 5, 0.05))
query("best_epochs", H + """ SELECT run, first(epoch ORDER BY metric DESC, epoch) AS best_epoch, first(epoch ORDER BY metric, epoch) AS worst_epoch, max(epoch) AS last_epoch FROM h GROUP BY 1""", False)(
    lambda s, d: history.extremes(daily(s, d))
)
query("pair_index", f", v AS ({V}), k AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS r FROM v) SELECT pair_id, a.r AS r1, b.r AS r2 FROM pairs JOIN k a ON a.entity = e1 JOIN k b ON b.entity = e2")(lambda s, d: vectors.pair_index(prepared(s, d).pairs, entity_vectors(s, d)))
query("two_hop_norms", f""", v AS ({V}), pv AS (SELECT pair_id, list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2])::FLOAT::DOUBLE) AS v FROM pairs JOIN v a ON a.entity = e1 JOIN v b ON b.entity = e2),
l1 AS (SELECT label_index, dim, sum(x) AS x FROM (SELECT label_index, unnest(range(len(v))) AS dim, unnest(v) AS x FROM positives JOIN pv USING (pair_id)) GROUP BY 1, 2),
p2 AS (SELECT pair_id, dim, sum(x) AS x FROM positives JOIN l1 USING (label_index) GROUP BY 1, 2) SELECT pair_id AS node, round(sqrt(sum(x * x)), 3) AS norm FROM p2 GROUP BY 1""")(
    lambda s, d: (lambda p: graph.hops(p.positives, vectors.pair_vectors(p.pairs, entity_vectors(s, d)), 2).select("node", F.round(vectors.norm(F.col("v")), 3).alias("norm")))(prepared(s, d))
)
query("hashed_sets", r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS w FROM documents), b AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(w || ':42'), 1, 8))::BIGINT % 2048)::INT AS b FROM w WHERE w <> '')
SELECT doc_id, count(b) AS n_bits, coalesce(sum(b), 0)::BIGINT AS bit_sum FROM documents LEFT JOIN b USING (doc_id) GROUP BY 1""", False)(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").withColumn("b", vectors.hashed_set(F.coalesce("text", F.lit("")))).select("doc_id", F.size("b").cast("long").alias("n_bits"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("bit_sum"))
)


def linear_examples(s: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """The examples of all pairs, in chunks, the number of labels and that of dimensions."""

    def make() -> DataFrame:
        x, v = stored_splits(s, d), entity_vectors(s, d)
        if x.schema["e1"].dataType.typeName() != "string":  # pairs by numbers: those of the vectors' names
            v = v.select(F.substring("entity", 4, 9).try_cast("long").alias("entity"), "v")
        return linear.packed(x, v, prepared(s, d).positives)

    return shared_frame(s, d, "examples", make), n_labels(s, d), s.read.parquet(f"{d}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]


@query("linear_scorer")
def linear_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of the test pairs' cells by the trained linear scorer, with their truth. No SQL states a training; a test compares it with plain numpy."""
    rows, n, dims = linear_examples(s, d)
    return linear.judged(linear.of_split(rows, "test"), linear.fit(linear.of_split(rows, "train"), n, dims))
