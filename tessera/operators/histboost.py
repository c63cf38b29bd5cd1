"""Gradient boosting of trees on histograms: second-order gains, best-first growth, L2 on leaf values.

Numbers are binned once, at exact ranks, and rows with equal bins and label are counted once, as they get
equal predictions for ever.  A node's histogram holds, for each feature and bin, the sums of gradients and
Hessians of the logistic loss and the rows.  The leaf with the largest gain is split next, until a tree has
``leaves`` leaves.  As the split of a leaf follows from its histogram alone, the children of all leaves that
could still be split are counted in one pass over the rows, so a tree takes about as many passes as it is
deep, not one for each leaf; the right child's histogram is its parent's without the left one's.

A counted table of at most ``FEW`` rows is boosted in one task.  Beyond that each pass is a Spark job whose
histograms are added up by ``sums.summed``, and predictions so far are written after every tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import quantiles
from tessera.operators.staging import delete, staged, written
from tessera.operators.sums import matrix, summed

FEW = 200_000
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-7


@dataclass
class Tree:
    """Node arrays; a leaf is its own child.  Rows go left if their bin is at most the node's."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        a, b = len(self.left), len(self.left) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, a, b
        for n in (a, b):
            self.feature.append(0), self.bin.append(0), self.left.append(n), self.right.append(n), self.value.append(0.0)
        return a, b

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            new = np.where(bins[rows, feature[node]] <= at[node], left[node], right[node])
            if (new == node).all():
                return node
            node = new


def histograms(bins: np.ndarray, node: np.ndarray, wanted: list[int], g: np.ndarray, h: np.ndarray, n: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """(features, bins, 3) sums of each wanted node, flat."""
    place = np.full(int(node.max(initial=0)) + 1, -1)
    for i, w in enumerate(wanted):
        if w < len(place):
            place[w] = i
    mine = place[node]
    rows = np.flatnonzero(mine >= 0)
    d = bins.shape[1]
    at = ((mine[rows, None] * d + np.arange(d)) * width + bins[rows]).ravel()
    size = len(wanted) * d * width
    found = [np.bincount(at, np.repeat(x[rows], d), size) for x in (g, h, n)]
    return {w: np.stack([f[i * d * width : (i + 1) * d * width] for f in found], axis=1).ravel() for i, w in enumerate(wanted)}


@dataclass
class Grower:
    features: int
    width: int
    leaves: int
    rate: float
    l2: float
    least: int

    def best(self, sums: np.ndarray) -> tuple[float, int, int]:
        """Gain, feature and bin of a node's best split (ties: first feature, lowest bin); a gain of 0 where it must not be split."""
        s = sums.reshape(self.features, self.width, 3)
        left = s.cumsum(axis=1)
        total = left[:, -1:, :]
        right = total - left
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + self.l2 + 1e-300)
        gain = score(left) + score(right) - score(total)
        fine = (np.minimum(left[..., 2], right[..., 2]) > self.least - 0.5) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN)
        gain = np.where(fine, np.round(gain, 9), 0.0)
        i = int(gain.argmax())
        return float(gain.flat[i]), i // self.width, i % self.width

    def value(self, sums: np.ndarray) -> float:
        g, h, _ = sums.reshape(self.features, self.width, 3)[0].sum(axis=0)
        return -self.rate * g / (h + self.l2 + 1e-300)

    def grow(self, count: Callable[[Tree, list[int]], dict[int, np.ndarray]]) -> Tree:
        """One tree: ``count`` gives the histograms of some leaves of a tree over all rows."""
        tried = Tree()  # every split whose children have been counted; the tree that is grown is a part of it
        sums = {0: count(tried, [0])[0]}
        splits = {0: self.best(sums[0])}
        chosen: list[int] = []  # nodes of ``tried`` that are split, in order
        open_leaves = {0}
        while len(chosen) < self.leaves - 1:
            node = min(open_leaves, key=lambda x: (-splits[x][0], x))
            if splits[node][0] <= LEAST_GAIN:
                break
            if tried.left[node] == node:
                left = self.leaves - 1 - len(chosen)
                likely = sorted((x for x in open_leaves if splits[x][0] > LEAST_GAIN), key=lambda x: (-splits[x][0], x))[:left]
                new = [(x, *tried.split(x, *splits[x][1:])) for x in likely if tried.left[x] == x]
                counted = count(tried, [a for _, a, _ in new])
                for parent, a, b in new:
                    sums[a] = counted.get(a, np.zeros_like(sums[0]))
                    sums[b] = sums[parent] - sums[a]
                    splits[a], splits[b] = self.best(sums[a]), self.best(sums[b])
            chosen.append(node)
            open_leaves.remove(node)
            open_leaves |= {tried.left[node], tried.right[node]}
        out, names = Tree(), {0: 0}
        for node in chosen:
            names[tried.left[node]], names[tried.right[node]] = out.split(names[node], tried.feature[node], tried.bin[node])
        for node in open_leaves:
            out.value[names[node]] = self.value(sums[node])
        return out


def _loss(raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of rows that stand for n each."""
    p = 1 / (1 + np.exp(-raw))
    return n * (p - y), n * p * (1 - p)


@dataclass
class HistBoost:
    """``fit`` on (features, label) and, where a row stands for several, copies; missing numbers fall into the lowest bin; no row, or a single label, gives a constant model."""

    # Fixed values.
    rounds: int = 80
    rate: float = 0.06
    leaves: int = 31
    l2: float = 0.05
    # Defaults of the method.
    least: int = 20
    bins: int = 255
    few: int | None = None

    def fit(self, df: DataFrame) -> HistModel:
        copies = F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")
        rows = staged(df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), copies.alias("copies")))
        cuts = bin_cuts(rows, self.bins)
        model = HistModel(cuts, [], 0.0)
        counted, path = written(rows.select(model.binned(F.col("x")).alias("v"), "y", "copies").groupBy("v", "y").agg(F.sum("copies").cast("double").alias("n")))
        total = counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p"), F.count(F.lit(1)).alias("rows")).first()
        if not total["rows"] or total["p"] in (0, total["n"]):
            model.start = 0.0 if not total["rows"] else 40.0 if total["p"] else -40.0
            return model
        model.start = float(np.log(total["p"] / (total["n"] - total["p"])))
        grower = Grower(len(cuts), max(len(c) for c in cuts) + 1, self.leaves, self.rate, self.l2, self.least)
        if total["rows"] <= (FEW if self.few is None else self.few):
            model.trees = self._in_one_task(counted, grower, model.start)
            delete(df.sparkSession, path)
        else:
            self._over_all(counted, path, grower, model)
        return model

    def _in_one_task(self, counted: DataFrame, grower: Grower, start: float) -> list[Tree]:
        rounds = self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pickle

            held = [b for b in batches if b.num_rows]
            if not held:
                return
            bins = np.concatenate([matrix(b) for b in held]).astype(np.int64)
            y, n = (np.concatenate([b.column(c).to_numpy().astype(float) for b in held]) for c in ("y", "n"))
            raw, trees = np.full(len(y), start), []
            for _ in range(rounds):
                g, h = _loss(raw, y, n)
                trees.append(grower.grow(lambda tree, wanted: histograms(bins, tree.route(bins), wanted, g, h, n, grower.width)))
                raw = raw + np.array(trees[-1].value)[trees[-1].route(bins)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])

        import pickle

        return pickle.loads(counted.repartition(1).mapInArrow(run, "trees binary").first()["trees"])

    def _over_all(self, counted: DataFrame, path: str, grower: Grower, model: HistModel) -> None:
        rows, last = written(counted.withColumn("raw", F.lit(model.start)))
        delete(counted.sparkSession, path)

        def counter(rows: DataFrame) -> Callable[[Tree, list[int]], dict[int, np.ndarray]]:
            def count(tree: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
                def totals(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
                    bins = matrix(batch).astype(np.int64)
                    raw, y, n = (batch.column(c).to_numpy().astype(float) for c in ("raw", "y", "n"))
                    return histograms(bins, tree.route(bins), wanted, *_loss(raw, y, n), n, grower.width)

                return summed(rows, totals)

            return count

        for _ in range(self.rounds):
            tree = grower.grow(counter(rows))
            model.trees.append(tree)

            def added(batches: Iterator[pa.RecordBatch], tree: Tree = tree) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    raw = batch.column("raw").to_numpy() + np.array(tree.value)[tree.route(matrix(batch).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw)], names=["v", "y", "n", "raw"])

            new, old = written(rows.mapInArrow(added, rows.schema)), last
            rows, last = new
            delete(counted.sparkSession, old)
        delete(counted.sparkSession, last)


def bin_cuts(rows: DataFrame, bins: int) -> list[list[float]]:
    """Upper ends of the bins of each number but the last one: all values if they are few, else those at which the ranks pass a multiple of rows / bins."""
    copies = [c for c in ("copies",) if c in rows.columns]
    values = rows.select(*copies, F.posexplode("x").alias("j", "v")).where("NOT isnan(v)")
    ranks = quantiles.ranked(values, ["j"], "v", *copies)
    sizes = ranks.groupBy("j").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"))
    passes = F.floor(F.col("upto") * bins / F.col("n")) > F.floor((F.col("upto") - F.col("c")) * bins / F.col("n"))
    ends = ranks.join(sizes, "j").where((F.col("values") <= bins) | passes).select("j", "value").toPandas()  # bins rows a number
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return [sorted(ends.loc[ends["j"] == j, "value"].tolist())[:-1] for j in range(width)]


@dataclass
class HistModel:
    cuts: list[list[float]]
    trees: list[Tree]
    start: float

    def binned(self, x: Column) -> Column:
        """For each number how many cuts lie below it; NaN is in bin 0."""
        cuts = self.cuts

        @F.pandas_udf("array<int>")
        def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(list(_bins(np.stack(part.to_numpy()), cuts))) if len(part) else pd.Series([], dtype=object)

        return find(x)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds score (probability of label 1) and prediction."""
        cuts, trees, start = self.cuts, self.trees, self.start

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                raw = np.full(len(part), start)
                if len(part) and trees:
                    bins = _bins(np.stack(part.to_numpy()), cuts)
                    for tree in trees:
                        raw += np.array(tree.value)[tree.route(bins)]
                yield pd.Series(1 / (1 + np.exp(-raw)))

        return df.withColumn("score", score(vector_to_array("features"))).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def _bins(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(np.array(c), x[:, j]))
    return out
