import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import clustering, density, graphs, models, patterns, profile, sessions
from tessera.sources import registry, tables
from tessera.streaming import events as streams

LEAKY = [f"target_{i}" for i in range(16)]


def test_features_exclude_leaks_and_constants(spark):
    rows = [(i, f"5G_{i % 2}", -80.0 - i, "same", *[i % 2] * 16) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, network_type string, signal double, constant string, " + ", ".join(f"{c} int" for c in LEAKY))
    assert models.feature_columns(df, [*LEAKY, "id"]) == (["signal"], ["network_type"])


def test_models_and_tree_rules(spark):
    df = spark.range(600).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"), (F.col("id") % 100 >= 40).cast("int").alias("y"))
    out = models.run_experiment(df, df, "y", ["x", "z"], ["c"], ["logistic_regression", "decision_tree_gini"]).toPandas()
    assert (out["training_status"] == "ok").all() and (out["f1"] > 0.9).all()
    rules = models.tree_rules(df, "y", ["x", "z"], least=20)
    rows, low, high = rules.agg(F.sum("row_count"), F.min("outcome_rate"), F.max("outcome_rate")).first()
    assert rows == 600 and low < 0.1 and high > 0.9
    assert models.representative_rules(rules).groupBy("predicted").count().where("count > 3").isEmpty()


def test_clusterings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) + 10 * (i % 2)).tolist(), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, truth int").withColumn("features", array_to_vector("v"))
    found = clustering.kmeans(df, "features", 2)
    assert clustering.adjusted_rand(found, "cluster", "truth").first()[0] == 1.0
    labels = found.orderBy("id").toPandas()["cluster"].to_numpy()
    assert abs(clustering.silhouette(found, "features", "cluster") - density.partition_scores(np.array([r[1] for r in rows]), labels)[3]) < 1e-6
    assert clustering.adjusted_rand(clustering.dbscan(df, "id", "v", 4.0, 3).join(df, "id"), "cluster", "truth").first()[0] > 0.9
    with pytest.raises(ValueError, match="more than"):
        clustering.dbscan(df, "id", "v", 4.0, 3, bound=10)
    _, scores = clustering.mixture(df, "features", 2)
    assert scores["bic"] > scores["aic"]
    flat = np.array([r["projection"] for r in clustering.projection(df, "v").orderBy("id").collect()])
    x = np.array([r[1] for r in rows])
    assert np.allclose(flat.var(axis=0), np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0)))[::-1][:2]) and np.allclose(flat.mean(axis=0), 0)
    gap = clustering.permutation_gap(df.withColumn("y", F.col("truth")), "truth", "y", 200).first()
    assert gap["observed_gap"] == 1.0 and gap["p_value"] < 0.02
    low, mean, high = clustering.bootstrap_means(df.withColumn("x", F.col("id")), "truth", "x").where("cluster = 0").select("ci_low", "mean", "ci_high").first()
    assert low < mean < high and abs(mean - 39) < 2


def test_radii_and_sweep(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 3)) + 12 * (i % 2) for i in range(2)] + [rng.uniform(-40, 50, size=(6, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(3)
    full = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    got = density.k_distances(df, "v", [2, 5, 500]).toPandas()
    for k in (2, 5, 500):
        assert np.allclose(np.sort(got[got.k == k].distance), np.sort(full[:, min(k, len(x)) - 1]), atol=1e-5)
    eps = {(r.k, r["quantile"]): r.eps for r in density.eps_candidates(density.k_distances(df, "v", [5]), [0.5, 0.9]).collect()}
    assert eps == {(5, q): round(float(np.quantile(full[:, 4], q)), 4) for q in (0.5, 0.9)}
    sweep = density.density_sweep(df, "v", [3, 5], [0.5, 0.9])
    best = density.best_setting(sweep).first()
    assert best.clusters == 2 and best.valid and best.silhouette > 0.7 and best.noise_fraction < 0.6
    for r in sweep.collect():  # scores of the sample agree with the clustering of all rows
        labels = clustering.dbscan(df, "id", "v", r.eps, r.min_samples).where("id < 900").toPandas()["cluster"]
        assert (labels.max() + 1, round((labels < 0).mean(), 9)) == (r.clusters, round(r.noise_fraction, 9))
    assert density.density_sweep(df.where("v IS NULL"), "v").count() == 0 and density.k_distances(df.limit(0), "v").count() == 0


def test_label_propagation_and_components(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("x", "y", 3.0), ("c", "x", 0.1)], "source string, target string, w double")
    found = {r.node_id: r.community for r in graphs.label_propagation(edges, "w").collect()}
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"]
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node_id string")
    assert {r.node_id: r.component for r in graphs.components(nodes, edges.where("w > 1")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_itemsets_agree_with_fpgrowth(spark):
    rows = patterns.transactions(spark.range(300).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 5 < 2).cast("int").alias("c")), ["a", "b", "c"])
    key = lambda df: {(tuple(r.itemset), r.n) for r in df.collect()}
    assert key(patterns.frequent_itemsets(rows, 0.1)) == key(patterns.fpgrowth_itemsets(rows, 0.1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, x double, c string")
    assert profile.missingness(empty).count() == 3
    assert sessions.temporal_holdout(empty, "id", "x").count() == 0
    assert patterns.transactions(empty, ["c"]).count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\""), (2, None)], "id long, text string")
    path = tables.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert tables.read_csv(spark, path, "id long, text string").orderBy("id").collect() == df.collect()
    parquet = tables.write_table(df, str(tmp_path / "t"), partition_by=["id"])
    assert tables.read_parquet(spark, parquet, ["text", "absent"]).columns == ["text"]
    assert tables.inventory(spark, str(tmp_path)).where("is_table").count() >= 3
    assert tables.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    assert spark.range(1).select(tables.path_parts(F.lit("/data/root/app/walk/x/f.csv"), "root")).first()[0] == ["app", "walk", "x"]
    assert tables.column_inventory(df).where("column_name = 'text'").first()["missing_count"] == 1
    entries = {"a": registry.Entry("x", required=("c",)), "b": registry.Entry("/y.csv", "csv", "id long", (), True)}
    assert registry.parse(registry.dump(entries)) == entries
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, str(tmp_path), ["absent"])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    query = streams.windowed_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "g", "y").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("rates").collect()) == sorted(streams.windowed_rates(rows, "ts", "g", "y").collect())


def test_radius_of_all_rows(spark):
    """More rows than the sample of 4,000 that radii came from, with copies; every row counts."""
    x = np.random.default_rng(8).normal(size=(4300, 2)).round(2)
    x = np.concatenate([x, np.full((300, 2), 90.0), [[200.0, 0.0]]])
    df = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").repartition(3)
    near = np.concatenate([np.sort(np.sqrt(((x[i : i + 500, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 9] for i in range(0, len(x), 500)])
    got = density.k_distances(df, "v", [10]).toPandas()
    assert got["copies"].sum() == len(x) and np.allclose(np.sort(np.repeat(got["distance"], got["copies"])), np.sort(near), atol=1e-5)
    assert abs(density.eps_candidates(density.k_distances(df, "v", [10]), [0.9]).first()["eps"] - np.quantile(near, 0.9)) < 1e-4
