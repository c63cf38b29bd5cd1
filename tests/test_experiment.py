"""The experiment's tables against each other and against what the data was made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, evaluation, models


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(F.col("id"), (F.col("id") % 60).alias("g"), (F.col("id") * 7 % 100).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    return df.withColumn("y", ((F.col("x") >= 40) != (F.col("id") % 29 == 0)).cast("int"))


def test_scored_rows_give_the_metrics_of_the_experiment(rows):
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    name = "hist_gradient_boosting"
    scored = models.scored_rows(train, test, "id", "y", ["x", "z"], ["c"], name).cache()
    whole = models.run_experiment(train, test, "y", ["x", "z"], ["c"], [name]).first()
    assert whole.training_status == "ok" and whole.f1 > 0.9
    one = evaluation.classification_metrics(scored, "actual", "predicted").first()
    assert (one.accuracy, one.f1) == (whole.accuracy, whole.f1)
    assert evaluation.confusion(scored, "actual", "predicted").agg(F.sum("n")).first()[0] == test.count()
    assert evaluation.calibration(scored, "actual", "probability").agg(F.sum("n")).first()[0] == test.count()
    assert scored.where("probability < 0 OR probability > 1").isEmpty()


def test_importances_find_what_matters(rows):
    table = models.importance_table(rows, "y", ["x", "z"], ["c"], ["decision_tree_gini", "logistic_regression"]).toPandas()
    assert (table[table["rank"] == 1]["feature"].str.contains("0") | table[table["rank"] == 1]["feature"].str.contains("x")).all()
    tree = table[table["model_name"] == "decision_tree_gini"]
    assert abs(tree["importance"].sum() - 1) < 1e-9 and (tree["importance"].diff().dropna() <= 0).all()


def test_rules_of_the_node_table(rows):
    rules = models.tree_rules(rows, "y", ["x", "z"], least=30).toPandas()
    assert rules["row_count"].sum() == 900 and (rules["row_count"] >= 30).all()
    for r in rules.itertuples():
        found = rows.where(r.rule).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).first()
        assert (found.n, found.k) == (r.row_count, r.outcome_count) and r.predicted == int(r.outcome_rate > 0.5)
    rare = rows.where("y = 0 OR id % 10 = 1")
    assert models.tree_rules(rare, "y", ["x"], least=10, balanced=True).where("predicted = 1").count() > 0


def test_repeated_runs_and_rule_stability(rows):
    seeds = [1, 2, 3]
    runs = models.repeated_experiment(rows, "g", "y", ["x", "z"], ["c"], ["decision_tree_gini"], seeds).toPandas()
    assert sorted(runs["seed"]) == seeds and (runs["training_status"] == "ok").all() and (runs["f1"] > 0.9).all()
    stable = {r.feature: r.seeds for r in models.rule_stability(rows, "g", "y", ["x", "z"], seeds, least=50).collect()}
    assert stable["x"] == 3


def test_graph_classifier_on_neighbourhoods(spark):
    """The outcome is the sign of the neighbours' mean, which a node's own feature does not show."""
    rng = np.random.default_rng(2)
    group = {f"n{i}": i % 20 for i in range(400)}
    nodes = [(n, float(rng.normal() + (1.5 if g % 2 else -1.5)), int(g % 2), i % 4 == 0) for i, (n, g) in enumerate(group.items())]
    edges = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and rng.random() < 0.6]
    out = models.propagated_classifier(spark.createDataFrame(nodes, "node_id string, x double, y int, is_test boolean"), spark.createDataFrame(edges, "source string, target string"), ["x"], "y", "is_test").first()
    assert out.training_status == "ok" and out.accuracy > 0.97


def test_clusters_of_sessions(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", float(rng.normal() + 20 * (s % 3)), "ab"[s % 2] if rng.random() < 0.9 else "ab"[(s + 1) % 2], int(rng.random() < (0.1, 0.5, 0.9)[s % 3])) for s in range(60) for _ in range(30)]
    df = spark.createDataFrame(rows, "s string, x double, c string, y int")
    scores, found = clustering.session_clusters(df, "s", "y", ["x"], ["c"], [2, 3, 4, 5, 6], 4)
    found = found.toPandas()
    assert len(found) == 60 and scores.count() == 5
    rates = found.groupby("cluster")["outcome_rate"].mean()
    assert list(rates) == sorted(rates) and list(rates.index) == list(range(len(rates)))
    assert found.assign(g=found["s"].str[1:].astype(int) % 3).groupby("cluster")["g"].nunique().max() <= 2
    assert clustering.session_clusters(df.where("s IN ('s1', 's2')"), "s", "y", ["x"], ["c"])[1].count() == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("c"), F.col("id").cast("double").alias("x"))
    runs = [sorted(tuple(round(v, 6) for v in r) for r in clustering.bootstrap_means(df.repartition(n), "c", "x", 100).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    w = clustering.poisson_weights(np.arange(20_000, dtype=np.uint64), 5, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and w.max() >= 5
    assert abs(np.corrcoef(w)[0, 1]) < 0.03
