"""Boosted stumps, the kernel machine and the vote of neighbours against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, models


def frame(spark, x, y):
    rows = [(v, float(c), 1.0) for v, c in zip(np.asarray(x, float).tolist(), y)]
    return spark.createDataFrame(rows, "v array<double>, label double, weight double").select(array_to_vector("v").alias("features"), "label", "weight").repartition(3)


def brute_adaboost(x, y, rounds, rate):
    """Decision values of rows: every threshold between distinct values, weights kept for each row."""
    w, total, votes = np.ones(len(y)), 0.0, np.zeros(len(y))
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j]):
                left = x[:, j] <= cut
                impurity, pred = 0.0, np.zeros(len(y), int)
                for side in (left, ~left):
                    if side.any():
                        p = w[side & (y == 1)].sum() / w[side].sum()
                        impurity += w[side].sum() * p * (1 - p) / w.sum()
                        pred[side] = p > 0.5
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, pred
        wrong = best[1] != y
        error = w[wrong].sum() / w.sum()
        if error >= 0.5:
            break
        alpha = 1.0 if error <= 0 else rate * np.log((1 - error) / error)
        votes, total, w = votes + alpha * (2 * best[1] - 1), total + alpha, w * np.exp(alpha * wrong)
        if error <= 0:
            break
    return votes / (total or 1.0)


def test_adaboost_against_plain_version(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(240, 3)).astype(float)
    y = ((x[:, 0] > 6) ^ (rng.random(240) < 0.1) | (x[:, 2] > 10)).astype(int)
    df = frame(spark, x, y)
    got = boosting.AdaBoost(8, 0.8).fit(df).transform(df.withColumn("v", F.col("features"))).collect()
    want = dict(zip(map(tuple, x), brute_adaboost(x, y, 8, 0.8)))
    assert len(got) == 240
    assert all(abs(r.score - want[tuple(r.v)]) < 1e-9 and r.prediction == float(r.score > 0) for r in got)


@pytest.mark.parametrize(("labels", "predicted"), [([1, 1, 1], 1.0), ([0, 0, 0], 0.0), ([0, 0, 1], None)])
def test_adaboost_of_few_rows(spark, labels, predicted):
    df = frame(spark, [[1.0, float("nan")], [2.0, 5.0], [3.0, 5.0]], labels)
    got = boosting.AdaBoost().fit(df).transform(df).select("label", "prediction").collect()
    assert all(r.prediction == (r.label if predicted is None else predicted) for r in got)


def test_kernel_machine_separates_a_ring(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    df = frame(spark, x, y)
    got = boosting.KernelMachine().fit(df).transform(df)
    assert got.where("label = prediction").count() > 570
    assert {"score", "prediction"} <= set(got.columns) and "_waves" not in got.columns


def test_experiment_rows(spark):
    df = spark.range(400).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"), (F.col("id") % 100 >= 40).cast("int").alias("y"))
    out = models.run_experiment(df, df, "y", ["x", "z"], ["c"], ["adaboost", "knn", "xgboost"]).toPandas().set_index("model_name")
    assert out.loc["xgboost", "training_status"] == "skipped_missing_dependency"
    fitted = out.loc[["adaboost", "knn"]]
    assert (fitted["training_status"] == "ok").all() and (fitted[["f1", "roc_auc", "average_precision"]] > 0.9).all().all()
