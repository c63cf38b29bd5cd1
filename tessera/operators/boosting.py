"""Learners that MLlib lacks: boosted stumps, a kernel machine by random features, and a vote of neighbours.

Each has ``fit(df)`` on (features, label, weight), with copies where a row stands for several (its weight is that
of all of them), and gives a model whose ``transform`` adds
``prediction`` and ``score`` to a table with ``features``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import quantiles
from tessera.operators.staging import staged

#: feature, largest bin of the left side, classes of both sides, weight of the vote
STUMP = "array<struct<feature: int, bin: int, left: int, right: int, alpha: double>>"


def _copies(df: DataFrame) -> Column:
    return F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")


def _stumps(found: list[tuple]) -> Column:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("feature", "bin", "left", "right", "alpha"))]) for s in found]
    return F.array(*rows).cast(STUMP)


def _side(bins: Column, s: Column) -> Column:
    return F.when(F.get(bins, s["feature"]) > s["bin"], s["right"]).otherwise(s["left"])


@dataclass
class AdaBoost:
    """Boosting of depth-one trees (SAMME) on quantile bins, whatever the number of rows.

    Rows with equal bins and label always have equal weights, so they are counted once and each round
    is one aggregate over (feature, bin); the driver gets at most features * (bins + 1) rows of it.
    Missing numbers fall into the lowest bin.  No row, or a single label, gives a model that predicts
    that label (0 without rows).
    """

    rounds: int = 40
    rate: float = 0.08
    bins: int = 32

    def fit(self, df: DataFrame) -> StumpModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), _copies(df).alias("copies"))
        steps = [i / self.bins for i in range(1, self.bins)]
        ranks = quantiles.ranked(rows.select("copies", F.posexplode("x").alias("j", "v")).where("NOT isnan(v)"), ["j"], "v", "copies")
        reached = ranks.join(ranks.groupBy("j").agg(F.sum("c").alias("n")), "j").groupBy("j").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n")), F.col("value"))).alias(f"q{i}") for i, p in enumerate(steps)])
        found = reached.select("j", F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(len(steps))]))).alias("cuts")).toPandas()
        cuts = [[] for _ in range(int(found["j"].max()) + 1 if len(found) else 0)]
        for j, c in zip(found["j"], found["cuts"]):
            cuts[j] = [float(x) for x in c]
        model = StumpModel(cuts, [])
        counted = staged(rows.select(model.binned(F.col("x")).alias("bins"), "y", "copies").groupBy("bins", "y").agg(F.sum("copies").cast("double").alias("n")))
        labels = {r.y for r in counted.select("y").distinct().collect()}  # two classes
        if len(labels) < 2:
            return StumpModel(cuts, [(0, 0, *[max(labels, default=0)] * 2, 1.0)])
        for _ in range(self.rounds):
            wrong = F.aggregate(_stumps(model.stumps), F.lit(0.0), lambda a, s: a + F.when(_side(F.col("bins"), s) != F.col("y"), s["alpha"]).otherwise(0.0))
            weighted = counted.select(F.posexplode("bins").alias("j", "bin"), "y", (F.col("n") * F.exp(wrong)).alias("w"))
            sums = weighted.groupBy("j", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p")).toPandas()
            stump, error = self._best(sums)
            if error >= 0.5:
                break
            model.stumps.append((*stump, 1.0 if error <= 0 else self.rate * float(np.log((1 - error) / error))))
            if error <= 0:
                break
        return model

    @staticmethod
    def _best(sums: pd.DataFrame) -> tuple[tuple[int, int, int, int], float]:
        """The split with the least weighted Gini impurity (ties: first feature, lowest bin) and its share of wrong weight."""
        best, least = ((0, 0, 0, 0), 1.0), np.inf
        for j, part in sorted(sums.groupby("j")):
            part = part.sort_values("bin")
            w, p = part["w"].to_numpy().cumsum(), part["p"].to_numpy().cumsum()
            sides = np.stack([w, w[-1] - w]), np.stack([p, p[-1] - p])
            share = np.divide(sides[1], sides[0], out=np.zeros_like(sides[0]), where=sides[0] > 1e-12 * w[-1])
            impurity = (sides[0] * share * (1 - share)).sum(axis=0) / w[-1]
            i = int(impurity.argmin())
            if impurity[i] < least - 1e-12:
                left, right = (int(s > 0.5) for s in share[:, i])
                missed = sum(min(s, 1 - s) * n for s, n in zip(share[:, i], sides[0][:, i]))
                best, least = ((int(j), int(part["bin"].iloc[i]), left, right), float(missed / w[-1])), impurity[i]
        return best


@dataclass
class StumpModel:
    cuts: list[list[float]]
    stumps: list[tuple] = field(default_factory=list)

    def binned(self, x: Column) -> Column:
        """For each number how many cuts lie below it."""
        cuts = F.array(*[F.array(*[F.lit(c) for c in cs]).cast("array<double>") for cs in self.cuts]).cast("array<array<double>>")
        return F.zip_with(x, cuts, lambda v, c: F.when(F.isnan(v), 0).otherwise(F.size(F.filter(c, lambda t: t < v))))

    def transform(self, df: DataFrame) -> DataFrame:
        bins = self.binned(vector_to_array("features"))
        total = sum(s[4] for s in self.stumps) or 1.0
        score = F.aggregate(_stumps(self.stumps), F.lit(0.0), lambda a, s: a + s["alpha"] * (2 * _side(bins, s) - 1)) / total
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") > 0).cast("double"))


@dataclass
class KernelMachine:
    """Radial kernel by random Fourier features and a linear machine: linear in the rows, where exact kernel machines are quadratic.

    The kernel's width is 1 / (features * variance of all entries) and the penalty 1 / rows.
    """

    features: int = 256
    iterations: int = 50
    seed: int = 42

    def fit(self, df: DataFrame) -> KernelModel:
        from pyspark.ml.classification import LinearSVC

        x = vector_to_array("features")
        c = _copies(df)
        mean = lambda e: F.sum(c * e) / F.sum(c)
        one = df.agg(F.sum(c).alias("n"), F.max(F.size(x)).alias("d"), mean(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).alias("s"), mean(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)).alias("q")).first()
        variance = one.q / one.d - (one.s / one.d) ** 2
        rng = np.random.default_rng(self.seed)
        width = np.sqrt(2.0 / (one.d * variance)) if variance > 0 else 1.0
        model = KernelModel(rng.normal(size=(one.d, self.features)) * width, rng.uniform(0, 2 * np.pi, self.features))
        linear = LinearSVC(featuresCol="_waves", labelCol="label", weightCol="weight", maxIter=self.iterations, regParam=1.0 / one.n)
        model.linear = linear.fit(model.waves(df))
        return model


@dataclass
class KernelModel:
    directions: np.ndarray
    phases: np.ndarray
    linear: object = None

    def waves(self, df: DataFrame) -> DataFrame:
        w, b = self.directions, self.phases

        @F.pandas_udf("array<double>")
        def project(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                z = np.cos(np.stack(x.to_numpy()) @ w + b) * np.sqrt(2 / len(b)) if len(x) else np.zeros((0, len(b)))
                yield pd.Series(list(z))

        return df.withColumn("_waves", array_to_vector(project(vector_to_array("features"))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self.waves(df)).withColumn("score", vector_to_array("rawPrediction")[1]).drop("_waves", "rawPrediction")


@dataclass
class Neighbours:
    """Distance-weighted vote of the k nearest training rows (see ``models.nearest_neighbours``)."""

    k: int = 7

    def fit(self, df: DataFrame) -> NeighbourModel:
        return NeighbourModel(df.select(vector_to_array("features").alias("v"), "label", _copies(df).alias("copies")), self.k)


@dataclass
class NeighbourModel:
    rows: DataFrame
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        """(label, copies where the table has them, score, prediction): the label stands in as the key, which need not be unique; a tied vote is 0."""
        from tessera.operators.models import nearest_neighbours

        keep = [c for c in ("copies",) if c in df.columns]
        asked = df.select(vector_to_array("features").alias("v"), "label", *keep)
        return nearest_neighbours(self.rows, asked, "label", "v", "label", self.k, "copies", keep).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
