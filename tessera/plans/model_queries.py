"""Evaluation, clustering and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import centres, clustering, density, evaluation, linkage, models, optics, sessions
from tessera.operators.staging import staged
from tessera.plans import bindings as b

L, E = f"WITH {b.LINES_SQL}", f"WITH {b.EVENTS_SQL}"
QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Evaluation: the score of an event is its k as a share, truth its outcome.
def _scored(s, d):
    return b.events(s, d).select("event_type", F.col("degraded").alias("actual"), (F.col("k") / 100).alias("p"), (F.col("k") >= 50).cast("int").alias("predicted"))


P = f"{E}, p AS (SELECT event_type, degraded AS actual, k / 100 AS p, (k >= 50)::INT AS predicted FROM e)"
_add("confusion_matrix", lambda s, d: evaluation.confusion(_scored(s, d), "actual", "predicted"), f"{P} SELECT a.x AS actual, q.x AS predicted, count(p.p) AS n FROM (SELECT unnest([0, 1]) AS x) a, (SELECT unnest([0, 1]) AS x) q LEFT JOIN p ON p.actual = a.x AND p.predicted = q.x GROUP BY 1, 2")
CELLS = "c AS (SELECT event_type, (count(*) FILTER (actual = 1 AND predicted = 1))::DOUBLE AS tp, (count(*) FILTER (actual = 0 AND predicted = 1))::DOUBLE AS fp, (count(*) FILTER (actual = 1 AND predicted = 0))::DOUBLE AS fn, (count(*) FILTER (actual = 0 AND predicted = 0))::DOUBLE AS tn FROM p GROUP BY 1)"
METRICS = "SELECT event_type, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c"
_metrics = lambda s, d: evaluation.classification_metrics(_scored(s, d), "actual", "predicted", ["event_type"])
_add("classification_metrics", _metrics, f"{P}, {CELLS} {METRICS}")
_add("rank_models", lambda s, d: evaluation.rank_models(_metrics(s, d), "event_type", ["f1", "accuracy"]), f"{P}, {CELLS}, mm AS ({METRICS}) SELECT *, row_number() OVER (ORDER BY f1 DESC, accuracy DESC, event_type)::INT AS overall_rank FROM mm")
_add("repeated_summary", lambda s, d: evaluation.repeated_summary(b.events(s, d).withColumn("v", F.col("k").cast("double")), "event_type", ["v"]).withColumn("v_std", F.round("v_std", 7)).withColumn("v_mean", F.round("v_mean", 7)), f"{E} SELECT event_type, count(*) AS repetitions, round(avg(k), 7) AS v_mean, round(stddev_samp(k), 7) AS v_std FROM e GROUP BY 1")
_add("roc_auc", lambda s, d: evaluation.roc_auc(_scored(s, d), "actual", "p"), f"{P}, r AS (SELECT actual, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS r FROM p) SELECT round(((sum(r) FILTER (actual = 1)) - sum(actual) * (sum(actual) + 1) / 2.0)::DOUBLE / (sum(actual) * sum(1 - actual))::DOUBLE, 9) AS roc_auc FROM r")
_add(
    "average_precision", lambda s, d: evaluation.average_precision(_scored(s, d), "actual", "p"),
    f"{P}, g AS (SELECT p, sum(actual) AS pos, count(*) AS n FROM p GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS total FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos::DOUBLE / total * tp / seen), 9) AS average_precision FROM c",
)
CAL = f"{P}, b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 9) AS mean_probability, sum(actual)::BIGINT / count(*) AS observed_rate FROM p GROUP BY 1)"
_add("calibration_bins", lambda s, d: evaluation.calibration(_scored(s, d), "actual", "p"), f"{CAL} SELECT * FROM b")
_add("ece_brier", lambda s, d: evaluation.calibration_error(_scored(s, d), "actual", "p"), f"{CAL} SELECT round(sum(n * abs(mean_probability - observed_rate)) / sum(n), 7) AS ece, (SELECT round(avg(pow(p - actual, 2)), 9) FROM p) AS brier FROM b")


# Clusters: two groups of customers by balance, and the labels of the embeddings.
def _customers(s, d):
    c = b.table(s, d, "customer")
    return c.select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") > 4500).cast("int").alias("cluster"), (F.col("c_custkey") % 7 < 3).cast("int").alias("outcome"), (F.col("c_custkey") % 3).cast("int").alias("other"))


C = "c AS (SELECT *, (c_acctbal > 4500)::INT AS cluster, (c_custkey % 7 < 3)::INT AS outcome, (c_custkey % 3)::INT AS other FROM customer)"
_add(
    "effect_sizes", lambda s, d: clustering.effect_sizes(_customers(s, d), "cluster", ["c_acctbal", "nation"]),
    f"WITH {C}, l AS (SELECT cluster, 'c_acctbal' AS metric, c_acctbal AS x FROM c UNION ALL SELECT cluster, 'nation', c_nationkey::DOUBLE FROM c), g AS (SELECT metric, count(*) FILTER (cluster = 0) AS n0, count(*) FILTER (cluster = 1) AS n1, avg(x) FILTER (cluster = 0) AS m0, avg(x) FILTER (cluster = 1) AS m1, var_samp(x) FILTER (cluster = 0) AS v0, var_samp(x) FILTER (cluster = 1) AS v1 FROM l GROUP BY 1)"
    " SELECT metric, n0 AS n_0, n1 AS n_1, round(m1 - m0, 6) AS mean_difference, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS standardised_difference FROM g",
)
_add(
    "risk_ratio", lambda s, d: clustering.risk_ratio(_customers(s, d), "cluster", "outcome"),
    f"WITH {C}, g AS (SELECT (sum(outcome) FILTER (cluster = 0))::BIGINT / count(*) FILTER (cluster = 0) AS rate_0, (sum(outcome) FILTER (cluster = 1))::BIGINT / count(*) FILTER (cluster = 1) AS rate_1 FROM c) SELECT *, rate_1 - rate_0 AS risk_difference, rate_1 / rate_0 AS risk_ratio FROM g",
)
_add(
    "adjusted_rand_index", lambda s, d: clustering.adjusted_rand(_customers(s, d), "cluster", "other"),
    f"""WITH {C}, t AS (SELECT cluster, other, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), q AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS total FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS rows FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)), k AS (SELECT sum(n * (n - 1) / 2) AS cols FROM (SELECT sum(n) AS n FROM t GROUP BY other))
    SELECT round((cells - rows * cols / (total * (total - 1) / 2)) / ((rows + cols) / 2 - rows * cols / (total * (total - 1) / 2)), 9) AS adjusted_rand_index FROM q, r, k""",
)
EMB = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS d FROM embeddings), ce AS (SELECT label, d, avg(x) AS c, count(*) AS n FROM x GROUP BY 1, 2)"
_add(
    "calinski_harabasz", lambda s, d: clustering.calinski_harabasz(b.table(s, d, "embeddings"), "label", "embedding").withColumn("calinski_harabasz", F.round("calinski_harabasz", 4)),
    f"""WITH {EMB}, g AS (SELECT d, avg(x) AS m FROM x GROUP BY 1), w AS (SELECT sum(pow(x - c, 2)) AS w FROM x JOIN ce USING (label, d)), bt AS (SELECT sum(n * pow(c - m, 2)) AS b FROM ce JOIN g USING (d)), z AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
    SELECT k AS clusters, round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM w, bt, z""",
)
_add(
    "davies_bouldin", lambda s, d: clustering.davies_bouldin(b.table(s, d, "embeddings"), "label", "embedding").withColumn("davies_bouldin", F.round("davies_bouldin", 5)),
    f"""WITH {EMB}, r AS (SELECT vec_id, label, sqrt(sum(pow(x - c, 2))) AS r FROM x JOIN ce USING (label, d) GROUP BY 1, 2), sp AS (SELECT label, avg(r) AS s FROM r GROUP BY 1),
    ap AS (SELECT a.label AS a, o.label AS o, sqrt(sum(pow(a.c - o.c, 2))) AS m FROM ce a JOIN ce o ON a.d = o.d AND a.label <> o.label GROUP BY 1, 2) SELECT round(avg(w), 5) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / m) AS w FROM ap JOIN sp x ON x.label = a JOIN sp y ON y.label = o GROUP BY 1)""",
)
_add(
    "cluster_profile", lambda s, d: clustering.profile(_customers(s, d), "cluster", ["c_acctbal"], ["c_mktsegment"]),
    f"""WITH {C}, m AS (SELECT cluster, c_mktsegment AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS t, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c_mktsegment) AS r FROM c GROUP BY 1, 2)
    SELECT cluster, 'c_acctbal' AS feature, count(*) AS size, round(avg(c_acctbal), 6) AS mean, quantile_cont(c_acctbal, 0.5) AS median, NULL AS mode, NULL AS mode_fraction FROM c GROUP BY 1
    UNION ALL SELECT cluster, 'c_mktsegment', t::BIGINT, NULL, NULL, v, n / t FROM m WHERE r = 1""",
)
_add("cluster_summary", lambda s, d: clustering.summarise_clusters(_customers(s, d), "other", "outcome"), f"WITH {C} SELECT other, count(*) AS row_count, sum(outcome)::BIGINT / count(*) AS outcome_rate, CASE WHEN sum(outcome)::BIGINT / count(*) <= 0.25 THEN 'stable' WHEN sum(outcome)::BIGINT / count(*) >= 0.6 THEN 'elevated' ELSE 'mixed' END AS profile FROM c GROUP BY 1")
_add(
    "relabel_clusters", lambda s, d: clustering.relabel(_customers(s, d), "other", "outcome").groupBy("other").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("k")),
    f"WITH {C}, g AS (SELECT other, count(*) AS n, sum(outcome)::BIGINT AS k FROM c GROUP BY 1) SELECT (row_number() OVER (ORDER BY k / n, other) - 1)::INT AS other, n, k FROM g",
)
_add("bootstrap_means", lambda s, d: clustering.bootstrap_means(_customers(s, d), "cluster", "c_acctbal"))
_add("permutation_gap", lambda s, d: clustering.permutation_gap(_customers(s, d), "other", "outcome"))


def _vectors(s, d):
    from pyspark.ml.functions import array_to_vector

    return b.table(s, d, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


_add("cluster_validation", lambda s, d: clustering.validation(_vectors(s, d), "features", [2, 3]))
_add("cluster_stability", lambda s, d: clustering.stability(_vectors(s, d), "features", "vec_id", 3, [1, 2, 3]))
_add("block_sensitivity", lambda s, d: clustering.block_sensitivity(_customers(s, d), {"money": ["c_acctbal"], "both": ["c_acctbal", "nation"]}))
_add("nearest_neighbours", lambda s, d: models.nearest_neighbours(b.table(s, d, "embeddings").where("vec_id % 5 > 0").withColumn("y", F.col("label") % 2), b.table(s, d, "embeddings").where("vec_id % 5 = 0"), "vec_id", "embedding", "y"))
_add(
    "silhouette_euclidean", lambda s, d: s.createDataFrame([(round(centres.silhouette(b.table(s, d, "embeddings"), "embedding", ["label"], rows=None)["label"], 6),)], "silhouette double"),
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, o.label AS other, sum(list_distance(a.v, o.v)) / count(*) AS m FROM e a JOIN e o ON a.vec_id <> o.vec_id GROUP BY 1, 2, 3),
    q AS (SELECT vec_id, max(m) FILTER (other = label) AS a, min(m) FILTER (other <> label) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q""",
)
_add("k_sweep", lambda s, d: centres.sweep_table(b.table(s, d, "embeddings"), "embedding"))
_add("best_k", lambda s, d: clustering.best_k(centres.sweep_table(_customers(s, d).select(F.array(F.col("c_acctbal") / 5000, F.col("nation") / 10).alias("v")), "v")))
_add("gaussian_mixture_bic", lambda s, d: centres.mixture_table(b.table(s, d, "embeddings"), "embedding"))
_add("kmeans", lambda s, d: clustering.kmeans(_vectors(s, d), "features", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
_add("bisecting_kmeans", lambda s, d: clustering.bisecting(_vectors(s, d), "features", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
_add("ward", lambda s, d: linkage.ward_all(b.table(s, d, "embeddings"), "vec_id", "embedding", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
_add("pca_projection", lambda s, d: clustering.projection(b.table(s, d, "embeddings"), "embedding").select("vec_id", F.round(F.col("projection")[0], 6).alias("x"), F.round(F.col("projection")[1], 6).alias("y")))


def _dbscan(s, d):
    """Every vector, with the radius that nine tenths of the 10-distances to all rows stay below."""
    rows = b.table(s, d, "embeddings")
    radius = density.eps_candidates(density.k_distances(rows, "embedding", [10]), [0.9]).first()
    return clustering.dbscan(rows, "vec_id", "embedding", radius["eps"] if radius else 0.0, 10)


_add("dbscan", _dbscan)
_add("dbscan_sweep", lambda s, d: density.density_sweep(b.table(s, d, "embeddings"), "embedding"))
_add("optics", lambda s, d: optics.optics(b.table(s, d, "embeddings"), "vec_id", "embedding"))
_add("optics_sweep", lambda s, d: optics.optics_sweep(b.table(s, d, "embeddings"), "embedding"))


# Models: does an order line hold an outcome?
NUMERIC, CATEGORICAL = ["l_quantity", "l_tax", "l_discount"], ["l_returnflag", "l_linestatus"]


def _experiment(s, d, names=("logistic_regression", "decision_tree_gini", "gradient_boosting")):
    return models.split_experiment(sessions.group_split(b.lines(s, d), "session_id"), "is_test", "degraded", NUMERIC, CATEGORICAL, names)


_add("model_comparison", _experiment)
_add("model_catalogue", lambda s, d: _experiment(s, d, [*models.catalogue(), *models.ABSENT]))
_add("radial_machine", lambda s, d: _experiment(s, d, ["rbf_svm"]))
_add("tree_rules", lambda s, d: models.representative_rules(models.tree_rules(b.lines(s, d), "degraded", NUMERIC)))


# The experiment's other tables
def _split(s, d):
    return sessions.group_split(b.lines(s, d), "session_id").select("degraded", "is_test", *NUMERIC, *CATEGORICAL)


def _model_rows(s, d):
    return staged(models.scored_counts(_split(s, d), "is_test", "degraded", NUMERIC, CATEGORICAL, "hist_gradient_boosting"))


LEAKS = {"l_discount": "part of the outcome", "l_extendedprice": "part of the outcome", "session_id": "identifier", "service_state": "not in the table"}
_add("model_confusion", lambda s, d: evaluation.confusion(_model_rows(s, d), "actual", "predicted", "copies"))
_add("model_calibration", lambda s, d: evaluation.calibration(_model_rows(s, d), "actual", "probability", copies="copies"))
_add("feature_importance", lambda s, d: models.importance_table(_split(s, d).where("NOT is_test"), "degraded", NUMERIC, CATEGORICAL, ["decision_tree_gini", "logistic_regression"]))
_add("repeated_experiment", lambda s, d: models.repeated_experiment(b.lines(s, d).select("session_id", "degraded", *NUMERIC, *CATEGORICAL), "session_id", "degraded", NUMERIC, CATEGORICAL, ["decision_tree_gini"], [1, 2, 3, 4, 5]))
_add("rule_stability", lambda s, d: models.rule_stability(b.lines(s, d), "session_id", "degraded", NUMERIC, [1, 2, 3, 4, 5]))
_add("exclusion_audit", lambda s, d: models.exclusion_audit(b.lines(s, d), LEAKS), "SELECT unnest(['l_discount', 'l_extendedprice', 'service_state', 'session_id']) AS column_name, unnest(['part of the outcome', 'part of the outcome', 'not in the table', 'identifier']) AS reason, unnest([true, true, false, true]) AS present FROM (SELECT count(*) FROM lineitem)")
_add("session_clusters", lambda s, d: clustering.session_clusters(b.lines(s, d), "session_id", "degraded", ["l_quantity", "l_tax"], ["l_returnflag"], [2, 3, 4], 5)[1].groupBy("cluster").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("outcome_rate"), 6).alias("outcome_rate")))
