"""Learners on counted rows: each distinct row once, with the results of all rows; splits without a join."""

import hashlib

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tessera.operators import evaluation, models, sessions, smo


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("g"), (F.col("id") * 7 % 20).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    return df.withColumn("y", ((F.col("x") >= 8) != (F.col("z") == 3)).cast("int"))


def test_splits_follow_from_a_hash(rows):
    found = sessions.group_splits(rows, "g", {"one": 1, "two": 2})
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    sides = found.select("g", "one", "two").distinct().toPandas()
    order = lambda seed: sorted(range(97), key=lambda g: hashlib.md5(f"{seed}||{g}".encode()).hexdigest())
    for name, seed in (("one", 1), ("two", 2)):
        assert set(sides[sides[name]]["g"]) == set(order(seed)[:19])
    assert sessions.group_splits(rows.limit(0), "g", {"one": 1}).count() == 0


def test_a_learner_sees_each_distinct_row_once(spark, rows):
    held = models.counted(rows, "y", ["x", "z"], ["c"])
    assert held.count() == rows.select("y", "x", "z", "c").distinct().count() < 100 and held.agg(F.sum("copies")).first()[0] == 2000
    prep, fit_on = models._prepared(held, ["x", "z"], ["c"])
    assert models.as_drawn(fit_on, DecisionTreeClassifier()).count() == fit_on.count()
    tree = DecisionTreeClassifier(weightCol="weight", minInstancesPerNode=30)
    many = models.as_drawn(fit_on, tree)
    assert many.count() == held.agg(F.sum(F.least("copies", F.lit(30)))).first()[0]
    assert abs(many.agg(F.sum("weight")).first()[0] - 2000) < 1e-6
    each = models.as_drawn(fit_on.withColumn("copies", F.lit(1)).limit(5), tree)
    assert each.count() == 5


def test_numbers_are_those_of_all_rows(spark, rows):
    some = rows.withColumn("x", F.when(F.col("z") == 1, None).otherwise(F.col("x")))
    prep = models.fit_preprocessor(models.counted(some, "y", ["x", "z"], ["c"]), ["x", "z"], ["c"])
    frame = some.toPandas()
    filled = frame["x"].fillna(sorted(frame["x"].dropna())[(frame["x"].count() + 1) // 2 - 1])
    assert abs(prep.means[0] - filled.mean()) < 1e-9 and abs(1 / prep.scales[0] - filled.std()) < 1e-9
    assert abs(1 / prep.scales[1] - frame["z"].std()) < 1e-9 and prep.values == [["a", "b"]]


def test_copies_count_in_metrics(spark):
    few = spark.createDataFrame([(1, 1.0, 0.9, 3), (0, 1.0, 0.8, 2), (1, 0.0, 0.3, 4), (0, 0.0, 0.1, 5)], "y int, p double, s double, copies long")
    all_rows = few.withColumn("i", F.explode(F.expr("sequence(1, copies)")))
    for f, args in ((evaluation.classification_metrics, ("y", "p")), (evaluation.roc_auc, ("y", "s")), (evaluation.average_precision, ("y", "s")), (evaluation.confusion, ("y", "p")), (evaluation.calibration, ("y", "s"))):
        assert sorted(f(few, *args, copies="copies").collect()) == sorted(f(all_rows, *args).collect())


def test_sample_of_the_radial_machine(spark):
    few = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("copies"))
    all_rows = few.withColumn("i", F.explode(F.expr("sequence(1, copies)")))
    taken = sessions.stratified_cap(few, "label", "key", 40, copies="copies").groupBy("key").count()
    assert sorted(taken.collect()) == sorted(sessions.stratified_cap(all_rows, "label", "key", 40).groupBy("key").count().collect())
    assert smo.LIMIT == 8000
