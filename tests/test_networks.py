"""Graph networks: gradients by differences, scores of joins against the dense forward pass, and what they learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import networks


def graph(n, rng):
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, size=(2 * n, 2)) if a != b}
    links |= {(b, a) for a, b in links} | {(i, i) for i in range(n)}
    return np.array(sorted(links)).T


@pytest.mark.parametrize("kind", networks.KINDS)
def test_gradients_by_differences(kind):
    rng = np.random.default_rng(1)
    source, target = graph(12, rng)
    hood, x, y = networks.Hood(kind, 12, source, target), rng.normal(size=(12, 3)), rng.integers(0, 2, 12)
    weights = [rng.normal(size=s) for s in ((4, 5), (4, 5), (6, 2), (6, 2))]
    importance = rng.random(12) * (np.arange(12) < 8)
    _, grads = networks.gradients(kind, weights, hood, x, y, importance)
    for w, g in zip(weights, grads):
        for at in [(0, 0), (w.shape[0] - 1, 1), (2, 1)]:
            kept, sides = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = kept + step
                sides.append(networks.gradients(kind, weights, hood, x, y, importance)[0])
            w[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - g[at]) < 1e-6


@pytest.mark.parametrize("kind", networks.KINDS)
def test_scores_equal_the_dense_pass(spark, kind):
    rng = np.random.default_rng(2)
    source, target = graph(40, rng)
    x = rng.normal(size=(40, 3))
    weights = [rng.normal(size=s) for s in ((4, 5), (4, 5), (6, 2), (6, 2))]
    a = np.zeros((40, 40))
    a[target, source] = 1
    degree = a.sum(axis=1)
    a = a / degree[:, None] if kind == "sage" else a / np.sqrt(np.outer(degree, degree))
    one = lambda v: np.column_stack([v, np.ones(40)])
    layer = lambda v, own, near: a @ one(v) @ near + (one(v) @ own if kind == "sage" else 0)
    out = layer(np.maximum(layer(x, *weights[:2]), 0), *weights[2:])
    want = 1 / (1 + np.exp(out[:, 0] - out[:, 1]))
    assert np.allclose(networks.forward(kind, weights, networks.Hood(kind, 40, source, target), x)[0], out)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    edges = spark.createDataFrame([(int(s), int(t)) for s, t in zip(source, target) if s < t] + [(3, 999)], "source long, target long")
    got = {r.node_id: r.score for r in networks.score(networks.Network(kind, weights, 1, 0.0), nodes, networks.neighbourhood(nodes, edges)).collect()}
    assert got.keys() == set(range(40)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_networks_learn_what_only_neighbours_know(spark):
    # The outcome is the sign of the neighbours' value, pairs of a chain; one value is null, one label unknown.
    part = F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test")
    value = lambda i: F.xxhash64(i) % 1000 / 1000.0
    mate = F.col("id").bitwiseXOR(F.lit(1))
    nodes = spark.range(1200).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 2).alias("group"), part.alias("part"), F.when(F.col("id") != 7, (value(mate) > 0).cast("int")).alias("y"), F.when(F.col("id") != 9, value(F.col("id"))).alias("v"))
    edges = spark.range(600).select((F.col("id") * 2).alias("source"), (F.col("id") * 2 + 1).alias("target"))
    out = {r.model_name: r for r in networks.graph_networks(nodes, edges, ["v"]).collect()}
    assert out["sage"].accuracy > 0.9 and out["gcn"].roc_auc > 0.6 and out["sage"].trained_nodes == 720
    assert {r.training_status for r in networks.graph_networks(nodes.limit(0), edges, ["v"]).collect()} == {"skipped: no rows to train or test"}


def test_networks_share_their_passes(spark):
    rng = np.random.default_rng(3)
    source, target = graph(30, rng)
    x = rng.normal(size=(30, 3))
    made = [networks.Network(kind, [rng.normal(size=s) for s in ((4, 5), (4, 5), (6, 2), (6, 2))], 1, 0.0) for kind in networks.KINDS]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    edges = spark.createDataFrame([(int(s), int(t)) for s, t in zip(source, target) if s < t], "source long, target long")
    got = networks.scores(made, nodes, networks.neighbourhood(nodes, edges))
    rows = {r.node_id: r for r in got.collect()}
    for i, n in enumerate(made):
        out = networks.forward(n.kind, n.weights, networks.Hood(n.kind, 30, source, target), x)[0]
        want = 1 / (1 + np.exp(out[:, 0] - out[:, 1]))
        assert all(abs(rows[at][f"score_{i}"] - want[at]) < 1e-9 for at in range(30))
