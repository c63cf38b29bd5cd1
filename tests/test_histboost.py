"""Histogram gradient boosting against a plain version that splits rows one leaf at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tessera.operators import histboost


def frame(spark, x, y):
    rows = [(v, float(c)) for v, c in zip(np.asarray(x, float).tolist(), y)]
    return spark.createDataFrame(rows, "v array<double>, label double").select(array_to_vector("v").alias("features"), "v", "label").repartition(3)


def plain(x, y, rounds, rate, leaves, l2, least):
    """Raw scores: every threshold between distinct values is tried in every leaf."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def best(rows):
            top = (0.0, None)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
            for j in range(x.shape[1]):
                for cut in np.unique(x[:, j])[:-1]:
                    a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(a), len(b)) < least or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = round(g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - whole, 9)
                    if gain > top[0]:
                        top = (gain, (a, b))
            return top

        parts = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(parts) < leaves:
            i = max(range(len(parts)), key=lambda i: (parts[i][1][0], -i))
            gain, halves = parts[i][1]
            if gain <= 1e-7:
                break
            parts[i : i + 1] = []
            parts += [(rows, best(rows)) for rows in halves]
        for rows, _ in parts:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return raw


@pytest.mark.parametrize("few", [None, 0])
def test_against_plain_version(spark, few):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, 300), rng.integers(0, 6, 300), rng.normal(size=300).round(1)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 2) ^ (rng.random(300) < 0.1)).astype(float)
    rounds = 3 if few == 0 else 12
    model = histboost.HistBoost(rounds=rounds, rate=0.3, leaves=6, least=5, few=few).fit(frame(spark, x, y))
    want = {tuple(v): r for v, r in zip(x.tolist(), plain(x, y, rounds, 0.3, 6, 0.05, 5))}
    got = model.transform(frame(spark, x, y)).select("v", "score", "prediction").collect()
    assert all(abs(np.log(r.score / (1 - r.score)) - want[tuple(r.v)]) < 1e-6 and r.prediction == float(r.score > 0.5) for r in got)
    assert max(len(t.value) for t in model.trees) == 11 and len(model.trees) == rounds


def test_bins_at_ranks(spark):
    values = np.random.default_rng(1).normal(size=2000)
    cuts = histboost.bin_cuts(spark.createDataFrame([([float(v), float(i % 4)],) for i, v in enumerate(values)] + [([float("nan"), 1.0],)], "x array<double>"), 10)
    assert cuts[1] == [0.0, 1.0, 2.0]
    sizes = np.bincount(np.searchsorted(np.array(cuts[0]), values))
    assert len(sizes) == 10 and sizes.min() >= 199 and sizes.max() <= 201


@pytest.mark.parametrize(("labels", "score"), [([1, 1, 1], 1.0), ([0, 0, 0], 0.0), ([], 0.5)])
def test_constant_models(spark, labels, score):
    df = frame(spark, [[1.0, float("nan")], [2.0, 5.0], [3.0, 5.0]][: len(labels)], labels) if labels else frame(spark, [[1.0, 2.0]], [0]).where("false")
    got = histboost.HistBoost().fit(df).transform(frame(spark, [[1.0, 2.0], [float("nan"), 0.0]], [0, 1])).collect()
    assert all(abs(r.score - score) < 1e-9 for r in got)
