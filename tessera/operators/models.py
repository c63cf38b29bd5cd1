"""Supervised models on MLlib: preprocessing, a catalogue, evaluation, tree rules."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import boosting, evaluation, histboost, quantiles, smo
from tessera.operators.staging import delete, folder, staged

#: Models of the catalogue whose library is not there: they get a row that says so.
ABSENT = ("xgboost",)
#: Rows of a partition that a tree of MLlib keeps in memory.
TASK_ROWS = 500_000


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns that may be used: not excluded and not constant (one aggregate decides)."""
    names = [(c, t) for c, t in df.dtypes if c not in excluded]
    distinct = df.agg(*[F.count_distinct(c).alias(c) for c, _ in names]).first() if names else {}
    usable = [(c, t) for c, t in names if distinct[c] > 1]
    return [c for c, t in usable if t != "string" and t != "boolean"], [c for c, t in usable if t in ("string", "boolean")]


def counted(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """Equal rows once: keys, label (double), the columns, and copies, the rows that each stands for.

    Whatever a learner is told about rows follows from this table, so the rows themselves are read once.
    """
    n = F.count(F.lit(1)) if copies is None else F.sum(copies)
    return staged(df.groupBy(*keys, F.col(label).cast("double").alias("label"), *numeric, *categorical).agg(n.alias("copies")))


@dataclass
class Preprocessor:
    """Median imputation and standardisation of numbers; missing as a value and one-hot for categories, unseen ones kept apart."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    values: list[list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds features."""
        numbers = [(_known(c, m) - F.lit(mean)) * F.lit(scale) for c, m, mean, scale in zip(self.numeric, self.medians, self.means, self.scales)]
        df = VectorSizeHint(inputCol="scaled", size=len(numbers), handleInvalid="optimistic").transform(df.withColumn("scaled", array_to_vector(F.array(*numbers))))
        parts = ["scaled"]
        if self.categorical:
            df = df.withColumns({f"{c}_t": F.col(c).cast("string") for c in self.categorical})
            texts, places, parts = [f"{c}_t" for c in self.categorical], [f"{c}_x" for c in self.categorical], ["scaled", *[f"{c}_h" for c in self.categorical]]
            for text, place, values in zip(texts, places, self.values):
                df = StringIndexerModel.from_labels(values, text, place, handleInvalid="keep").transform(df)
            df = OneHotEncoder(inputCols=places, outputCols=parts[1:], dropLast=False).fit(df).transform(df)
        return VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep").transform(df)


def _known(column: str, otherwise: float | None = None) -> Column:
    """The number, or what stands for null and NaN."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return x if otherwise is None else F.coalesce(x, F.lit(otherwise))


def fit_preprocessor(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
    """From counted rows: medians where values are missing, means, sample deviations, values by falling frequency; a constant number becomes 0."""
    n = F.col("copies")
    gaps = rows.agg(F.lit(0), *[F.count_if(_known(c).isNull()).alias(f"g{i}") for i, c in enumerate(numeric)]).first()
    medians = [0.0] * len(numeric)
    if some := [i for i in range(len(numeric)) if gaps[f"g{i}"]]:
        long = rows.select("copies", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), _known(numeric[i]).alias("x")) for i in some])))
        ranks = quantiles.ranked(long, ["i"], "x", "copies")
        middle = ranks.join(ranks.groupBy("i").agg(F.sum("c").alias("n")), "i").where(F.col("upto") >= F.ceil(F.col("n") / 2)).groupBy("i").agg(F.min("value").alias("median"))
        for r in middle.collect():  # one row for each number
            medians[r["i"]] = float(r["median"])
    x = [_known(c, m) for c, m in zip(numeric, medians)]
    one = rows.agg(F.sum(n).alias("n"), *[(F.sum(v * n) / F.sum(n)).alias(f"m{i}") for i, v in enumerate(x)]).first()
    means = [one[f"m{i}"] or 0.0 for i in range(len(x))]
    spread = rows.agg(F.lit(0), *[F.sum(n * F.pow(v - F.lit(m), 2)).alias(f"s{i}") for i, (v, m) in enumerate(zip(x, means))]).first()
    deviations = [(float(spread[f"s{i}"] or 0) / max((one["n"] or 0) - 1, 1)) ** 0.5 for i in range(len(x))]
    values: list[list[str]] = [[] for _ in categorical]
    if categorical:
        long = rows.select("copies", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical)]))).where("v IS NOT NULL")
        for r in long.groupBy("i", "v").agg(F.sum("copies").alias("n")).orderBy("i", F.desc("n"), "v").collect():  # the values, which the features have a place for each
            values[r["i"]].append(r["v"])
    return Preprocessor(list(numeric), list(categorical), medians, means, [1 / d if d > 0 else 0.0 for d in deviations], values)


def catalogue(label: str = "label", weight: str = "weight") -> dict:
    """Models by name, with balanced class weights where the method takes weights; depths, rounds, rates and least leaf sizes are fixed values."""
    shared = {"featuresCol": "features", "labelCol": label}
    return {
        "logistic_regression": LogisticRegression(**shared, weightCol=weight, maxIter=50),
        "linear_svm": LinearSVC(**shared, weightCol=weight, maxIter=50),
        "decision_tree_gini": DecisionTreeClassifier(**shared, weightCol=weight, maxDepth=8, minInstancesPerNode=100, impurity="gini"),
        "decision_tree_entropy": DecisionTreeClassifier(**shared, weightCol=weight, maxDepth=8, minInstancesPerNode=100, impurity="entropy"),
        "random_forest": RandomForestClassifier(**shared, weightCol=weight, numTrees=80, maxDepth=14, seed=42),
        "gradient_boosting": GBTClassifier(**shared, weightCol=weight, maxIter=40, maxDepth=5, seed=42),
        "gaussian_naive_bayes": NaiveBayes(**shared, weightCol=weight, modelType="gaussian"),
        "adaboost": boosting.AdaBoost(rounds=40, rate=0.08),
        "hist_gradient_boosting": histboost.HistBoost(),
        "rbf_svm": smo.RadialMachine(),
        "rbf_fourier": boosting.KernelMachine(),
        "knn": boosting.Neighbours(k=7),
    }


def balanced_weights(df: DataFrame, label: str, copies: str | None = None) -> DataFrame:
    """n / (2 * class size) for each row; with ``copies``, of all rows that it stands for."""
    c = F.count(F.lit(1)) if copies is None else F.sum(copies)
    n = df.groupBy(label).agg(c.alias("_c"))
    total = df.agg(c.alias("_n"))
    share = F.col("_n") / (2 * F.col("_c"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", share if copies is None else share * F.col(copies)).drop("_c", "_n")  # two classes, one row


def as_drawn(rows: DataFrame, model) -> DataFrame:
    """Counted rows as a learner of MLlib has to see them.

    Most know weights, and a row may stand for all that equal it.  A least number of rows in a leaf, m, counts
    rows: a row comes min(copies, m) times, the weight divided, so that a leaf has m rows exactly where it
    had.  A forest draws rows one by one, so it gets them all.
    """
    if isinstance(model, RandomForestClassifier):
        times = F.col("copies")
    elif model.hasParam("minInstancesPerNode") and model.getMinInstancesPerNode() > 1:
        times = F.least("copies", F.lit(model.getMinInstancesPerNode()).cast("long"))
    else:
        return rows
    many = rows.agg(F.sum(times)).first()[0] or 0
    apart = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-many // TASK_ROWS)))
    return apart.withColumn("_times", times).withColumn("weight", F.col("weight") / F.col("_times")).withColumn("_each", F.explode(F.array_repeat(F.lit(True), F.col("_times").cast("int")))).drop("_times", "_each")


def fit(model, rows: DataFrame):
    """A model of the catalogue on counted rows (features, label, weight, copies)."""
    return model.fit(as_drawn(rows, model) if hasattr(model, "hasParam") else rows)


def _prepared(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[Preprocessor, DataFrame]:
    """What makes features, and the counted rows with features and weights."""
    prep = fit_preprocessor(train, numeric, categorical)
    return prep, staged(balanced_weights(prep.transform(train), "label", "copies").select("features", "label", "weight", "copies"))


def _with_score(found: DataFrame) -> DataFrame:
    return found if "score" in found.columns else found.withColumn("score", vector_to_array("probability" if "probability" in found.columns else "rawPrediction")[1])


def run_experiment(train: DataFrame, test: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str], copies: str | None = None) -> DataFrame:
    """Fit the named models; one row of metrics each (areas under both curves included), or of the error that stopped it.

    Both sides are counted first (their rows may stand for ``copies`` already), and all that follows sees each distinct row once.
    """
    train, test = (counted(side, label, numeric, categorical, copies=copies) for side in (train, test))
    prep, fit_on = _prepared(train, numeric, categorical)
    score_on = staged(prep.transform(test).select("features", "label", "copies"))
    models, out = catalogue(), None
    for name in names:
        try:
            if name in ABSENT:
                row = train.sparkSession.createDataFrame([(name, "skipped_missing_dependency")], "model_name string, training_status string")
            else:
                scored = staged(_with_score(fit(models[name], fit_on).transform(score_on)).select("label", "prediction", "score", "copies"))
                areas = evaluation.roc_auc(scored, "label", "score", "copies").crossJoin(evaluation.average_precision(scored, "label", "score", "copies"))  # one row each
                row = evaluation.classification_metrics(scored, "label", "prediction", copies="copies").crossJoin(areas).withColumns({"model_name": F.lit(name), "training_status": F.lit("ok")})
        except Exception as error:  # a model that cannot be trained is a row of the report
            row = train.sparkSession.createDataFrame([(name, f"failed: {type(error).__name__}")], "model_name string, training_status string")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def split_experiment(df: DataFrame, is_test: str, label: str, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The experiment on a table that tells its sides by a column; both are counted in one pass."""
    rows = counted(df, label, numeric, categorical, [is_test])
    return run_experiment(rows.where(~F.col(is_test)), rows.where(is_test), "label", numeric, categorical, names, "copies")


def tree_rules(df: DataFrame, label: str, numeric: Sequence[str], depth: int = 4, least: int = 150, impurity: str = "gini", balanced: bool = False, copies: str | None = None) -> DataFrame:
    """Leaf rules of a shallow tree on raw columns: conditions, rows, positives and rate of each leaf.

    Trees do not depend on scales, so thresholds are those of the columns themselves.  The rules come from the
    node table that the model writes, and every row has to fall into one leaf.  With ``balanced``, both classes
    weigh the same in the fit; a split needs twice ``least`` rows, as both sides need ``least``.  Equal rows are
    counted first (they may stand for ``copies`` already).
    """
    held = counted(df, label, numeric, [], copies=copies)
    weighted = balanced_weights(held, "label", "copies") if balanced else held.withColumn("weight", F.col("copies").cast("double"))
    assembled = VectorAssembler(inputCols=list(numeric), outputCol="features").transform(weighted).select("features", "label", "weight", "copies")
    nodes = node_table(fit(DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, impurity=impurity, weightCol="weight"), assembled))
    rules: list[tuple[int, str, int]] = []

    def visit(node: int, path: list[str]) -> None:
        n = nodes[node]
        if n["leftChild"] < 0:
            rules.append((len(rules) + 1, " AND ".join(path) or "true", int(n["prediction"])))
            return
        column, cut = f"`{numeric[n['split']['featureIndex']]}`", n["split"]["leftCategoriesOrThreshold"][0]
        visit(n["leftChild"], [*path, f"{column} <= {cut}D"])
        visit(n["rightChild"], [*path, f"{column} > {cut}D"])

    visit(0, [])
    leaf = F.lit(None).cast("int")
    for number, condition, _ in reversed(rules):
        leaf = F.when(F.expr(condition), number).otherwise(leaf)
    stats = staged(held.withColumn("leaf", leaf).groupBy("leaf").agg(F.sum("copies").alias("row_count"), F.sum(F.col("label").cast("long") * F.col("copies")).alias("outcome_count")))
    if not stats.where("leaf IS NULL").isEmpty():
        raise ValueError("rows without a value in one of the columns fall into no leaf")
    names = df.sparkSession.createDataFrame(rules, "leaf int, rule string, predicted int")
    return names.join(stats, "leaf").withColumn("outcome_rate", F.col("outcome_count") / F.col("row_count"))


def node_table(model) -> dict[int, dict]:
    """Nodes of a tree as the model writes them: id -> prediction, leftChild, rightChild (-1 for leaves), split."""
    spark = SparkSession.getActiveSession()
    path = f"{folder(spark)}/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    found = {r["id"]: r.asDict(recursive=True) for r in spark.read.parquet(f"{path}/data").collect()}  # at most 2^(depth + 1) rows
    delete(spark, path)
    if any(n["leftChild"] >= 0 and n["split"]["numCategories"] >= 0 for n in found.values()):
        raise ValueError("only trees on numbers have rules")
    return found


def importance_table(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str], top: int = 40) -> DataFrame:
    """model_name, rank, feature, importance: the largest importances (or absolute coefficients) of fitted models, by encoded column."""
    rows = counted(df, label, numeric, categorical)
    prep, fit_on = _prepared(rows, numeric, categorical)
    attrs = prep.transform(rows).schema["features"].metadata["ml_attr"]["attrs"]
    columns = [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])]
    models, out = catalogue(), []
    for name in names:
        out += [(name, i + 1, c, v) for i, (c, v) in enumerate(importances(fit(models[name], fit_on), columns, top))]
    return df.sparkSession.createDataFrame(out, "model_name string, rank int, feature string, importance double")


def scored_rows(train: DataFrame, test: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str], name: str) -> DataFrame:
    """key, actual, predicted, probability of the test rows by one model: what confusion, calibration and curves are made of."""
    prep, fit_on = _prepared(counted(train, label, numeric, categorical), numeric, categorical)
    found = _with_score(fit(catalogue()[name], fit_on).transform(prep.transform(test)))
    return found.select(key, F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), F.col("score").alias("probability"))


def scored_counts(df: DataFrame, is_test: str, label: str, numeric: Sequence[str], categorical: Sequence[str], name: str) -> DataFrame:
    """actual, predicted, probability and copies of the distinct test rows by one model: the same as ``scored_rows`` without keys, each row scored once."""
    rows = counted(df, label, numeric, categorical, [is_test])
    prep, fit_on = _prepared(rows.where(~F.col(is_test)), numeric, categorical)
    found = _with_score(fit(catalogue()[name], fit_on).transform(prep.transform(rows.where(is_test))))
    return found.select(F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), F.col("score").alias("probability"), "copies")


def representative_rules(rules: DataFrame, per_class: int = 3) -> DataFrame:
    """For each class the rules with the highest confidence * ln(1 + rows)."""
    from pyspark.sql import Window

    confidence = F.when(F.col("predicted") == 1, F.col("outcome_rate")).otherwise(1 - F.col("outcome_rate"))
    scored = rules.withColumn("rule_score", confidence * F.log1p("row_count"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("predicted").orderBy(F.desc("rule_score"), "leaf"))).where(F.col("r") <= per_class)


def rules_text(rules: DataFrame, title: str) -> DataFrame:
    """A report of rules, line by line: a heading with totals, then each rule with its measures."""
    head = rules.agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows")).select(F.lit(0).cast("long").alias("at"), F.format_string(f"# {title}: %d rules, %d rows", F.col("n"), F.col("rows")).alias("value"))
    body = rules.select(F.col("leaf").cast("long").alias("at"), F.format_string("%d. IF %s THEN %d (rows %d, rate %.4f)", F.col("leaf"), F.col("rule"), F.col("predicted"), F.col("row_count"), F.col("outcome_rate")).alias("value"))
    return head.unionByName(body).orderBy("at").select("value")


def importances(model, names: Sequence[str], top: int = 40) -> list[tuple[str, float]]:
    """Largest feature importances of a tree model, or absolute coefficients of a linear one."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    pairs = [(n, abs(float(v))) for n, v in zip(names, values.toArray())]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:top]


def exclusion_audit(df: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """Each column that may not be a predictor, why, and whether the table holds it."""
    return df.sparkSession.createDataFrame([(c, why, c in df.columns) for c, why in sorted(excluded.items())], "column_name string, reason string, present boolean")


def repeated_experiment(df: DataFrame, group: str, label: str, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """The experiment on one grouped split for each seed: metrics with their seed.  All splits are counted in one pass over the rows."""
    from tessera.operators.sessions import group_splits

    sides = {seed: f"_test_{i}" for i, seed in enumerate(seeds)}
    rows = counted(group_splits(df, group, {side: seed for seed, side in sides.items()}), label, numeric, categorical, list(sides.values()))
    out = None
    for seed, side in sides.items():
        part = run_experiment(rows.where(~F.col(side)), rows.where(side), "label", numeric, categorical, names, "copies").withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 7, copies: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Distance-weighted votes of the k nearest training rows (each standing for ``copies``) for each test row, whatever the sizes; test rows keep the columns ``keep``.

    Distinct test vectors and distinct training rows go into metric indexes with the same pivots; only pairs
    of blocks that may hold one of the k nearest are compared, and what their tiles give is merged.  Equal distances are taken by label; training rows without vector or label
    do not vote; a null vector, or no training row, gives a null score.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.operators import metric

    each = F.lit(1).cast("long") if copies is None else F.col(copies)
    votes = train.select(F.col(vector).alias("v"), F.col(label).cast("double").alias("y"), each.alias("n")).dropna().groupBy("v", "y").agg(F.least(F.sum("n"), F.lit(k)).cast("int").alias("m"))  # copies beyond k cannot vote
    held = metric.build(votes, ["y", "m"])
    rows = test.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *keep)
    asked = metric.build(rows.select("v").dropna().distinct(), [], held.pivots)

    def best(pairs):
        """The k nearest rows in a tile of each asked row; a block without rows that could be nearer ends its search."""
        held, done = None, None

        def out():
            r, exact, y, m = held[1:]
            near = pa.StructArray.from_arrays([pa.array(exact), pa.array(y), pa.array(m)], ["d", "y", "m"])
            size = len(held[0].x)
            ends = np.searchsorted(r, np.arange(size + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, held[0].block)), pa.array(np.arange(size, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), near)], names=["block", "at", "near"])

        for q, side in pairs:
            if held is None or held[0].block != q.block:
                if held is not None:
                    yield out()
                held, done = (q, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int32)), np.inf
            if q.apart > done:
                continue
            x, t = q.x, side.x
            d = metric.squares(x, t)
            # What may be among the k best but for rounding is measured again, exactly.
            last = np.partition(d, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
            r, c = np.nonzero(d <= (last + 1e-9 * (1 + (x**2).sum(axis=1) + (t**2).sum(axis=1).max()))[:, None])
            exact = np.sqrt(np.concatenate([((x[r[j : j + 65536]] - t[c[j : j + 65536]]) ** 2).sum(axis=1) for j in range(0, len(r), 65536)]))
            both = [np.concatenate(p) for p in zip(held[1:], (r, exact, side.tag("y")[c], side.tag("m")[c]))]
            r, exact, y, m = (p[np.lexsort((both[2], both[1], both[0]))] for p in both)
            use = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) < k)
            held = q, r[use], exact[use], y[use], m[use]
            if np.bincount(held[1], minlength=len(x)).min() >= k:
                done = held[2].max() + slack

        if held is not None:
            yield out()

    slack = max(asked.slack, held.slack)
    parts = metric.nearest(asked, held, k, best, "block long, at int, near array<struct<d: double, y: double, m: int>>")
    step = lambda s, n: (lambda t: F.struct((s["left"] - t).alias("left"), (s["sum"] + t * n["y"] / F.greatest(n["d"], F.lit(1e-9))).alias("sum"), (s["weight"] + t / F.greatest(n["d"], F.lit(1e-9))).alias("weight")))(F.least(s["left"], n["m"]))
    start = F.struct(F.lit(k).alias("left"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"))
    merged = parts.groupBy("block", "at").agg(F.aggregate(F.array_sort(F.flatten(F.collect_list("near"))), start, step, lambda s: s["sum"] / s["weight"]).alias("score"))
    scores = asked.blocks.select("block", F.posexplode("rows").alias("at", "row")).join(merged, ["block", "at"]).select("row.v", "score")
    return rows.join(scores, "v", "left").select(F.col("key").cast("long").alias(key), *keep, "score")


def rule_stability(df: DataFrame, group: str, label: str, numeric: Sequence[str], seeds: Sequence[int], depth: int = 4, least: int = 150) -> DataFrame:
    """How often each condition of a shallow tree comes back over grouped training splits."""
    from tessera.operators.sessions import group_splits

    sides = {seed: f"_test_{i}" for i, seed in enumerate(seeds)}
    rows = counted(group_splits(df, group, {side: seed for seed, side in sides.items()}), label, numeric, [], list(sides.values()))
    out = None
    for seed, side in sides.items():
        rules = tree_rules(rows.where(~F.col(side)), "label", numeric, depth, least, copies="copies")
        conditions = rules.select(F.explode(F.split("rule", " AND ")).alias("condition"))
        part = conditions.select(F.regexp_extract("condition", "`([^`]+)`", 1).alias("feature")).where("feature <> ''").groupBy("feature").agg(F.count(F.lit(1)).alias("splits")).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("seeds"), F.sum("splits").alias("splits"))


def propagated_classifier(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], label: str, is_test: str, rounds: int = 2) -> DataFrame:
    """Graph classification without back-propagation: features averaged over the neighbourhood, then logistic regression; metrics on the test side."""
    from tessera.operators.graphs import neighbour_mean

    smooth = neighbour_mean(nodes.select("node_id", *columns), edges, columns, rounds)
    rows = smooth.join(nodes.select("node_id", F.col(label).alias("_y"), F.col(is_test).alias("_test")), "node_id")
    return run_experiment(rows.where("NOT _test"), rows.where("_test"), "_y", columns, [], ["logistic_regression"])
