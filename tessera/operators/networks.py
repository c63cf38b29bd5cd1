"""Two-layer graph networks: trained in numpy on a bounded sample of groups, applied to every node by joins.

``sage`` adds a layer of the node itself to one of the mean over its neighbourhood (itself included);
``gcn`` has only the neighbourhood, weighed by the square roots of both degrees.  The sample is of
whole groups (sessions), so that neighbourhoods stay whole; scores use all nodes and all edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.operators.staging import staged

#: Fixed values of training.
HIDDEN, RATE, DECAY, DROPOUT, EPOCHS, PATIENCE, SEED = 32, 0.01, 1e-4, 0.15, 120, 18, 42
#: Most nodes, and edges for each of them, of the training sample.
SAMPLE_NODES, SAMPLE_DEGREE = 50_000, 8
KINDS = ("sage", "gcn")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


class Hood:
    """Weighted sums over the incoming edges of each node, and their transpose."""

    def __init__(self, kind: str, n: int, source: np.ndarray, target: np.ndarray):
        degree = np.bincount(target, minlength=n).astype(float)
        weight = 1 / degree[target] if kind == "sage" else 1 / np.sqrt(degree[source] * degree[target])
        self.ways = [self._sorted(*way, weight) for way in ((source, target), (target, source))]

    @staticmethod
    def _sorted(source, target, weight):
        order = np.argsort(target, kind="stable")
        return source[order], weight[order][:, None], np.flatnonzero(np.diff(target[order], prepend=-1))

    def sums(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Every node has an edge to itself, so no run of edges is empty."""
        source, weight, starts = self.ways[back]
        return np.add.reduceat(x[source] * weight, starts, axis=0)


def forward(kind: str, weights: Sequence[np.ndarray], hood: Hood, x: np.ndarray, mask: np.ndarray | None = None):
    """Class scores of all nodes, and what the backward pass needs."""
    own1, near1, own2, near2 = weights
    x = _ones(x)
    ax = hood.sums(x)
    z = ax @ near1 + (x @ own1 if kind == "sage" else 0)
    h = np.maximum(z, 0) * (1 if mask is None else mask)
    g = _ones(h)
    ag = hood.sums(g)
    return ag @ near2 + (g @ own2 if kind == "sage" else 0), (x, ax, z, g, ag)


def gradients(kind: str, weights: Sequence[np.ndarray], hood: Hood, x, y, importance, mask=None) -> tuple[float, list[np.ndarray]]:
    """Weighted cross entropy (``importance`` is 0 for nodes that do not train) and its gradients."""
    out, (x1, ax, z, g, ag) = forward(kind, weights, hood, x, mask)
    out = out - out.max(axis=1, keepdims=True)
    p = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
    share = importance / importance.sum()
    loss = -float(share @ np.log(p[np.arange(len(y)), y] + 1e-300))
    d = (p - np.eye(p.shape[1])[y]) * share[:, None]
    sage = float(kind == "sage")
    back = hood.sums(d @ weights[3].T, back=True) + sage * d @ weights[2].T
    dz = back[:, :-1] * (z > 0) * (1 if mask is None else mask)
    return loss, [sage * x1.T @ dz, ax.T @ dz, sage * g.T @ d, ag.T @ d]


@dataclass
class Network:
    kind: str
    weights: list[np.ndarray]
    epochs: int
    validation_f1: float


def _f1(y: np.ndarray, p: np.ndarray) -> float:
    hit = int((y & p).sum())
    return 2 * hit / max(1, int(y.sum() + p.sum()))


def train(kind: str, x: np.ndarray, y: np.ndarray, part: np.ndarray, source: np.ndarray, target: np.ndarray) -> Network:
    """Adam on the train part, stopped when F1 of the validation part has not grown for a while; the best epoch stays."""
    rng, hood = np.random.default_rng(SEED), Hood(kind, len(x), source, target)
    shapes = [(x.shape[1] + 1, HIDDEN)] * 2 + [(HIDDEN + 1, 2)] * 2
    weights = [rng.uniform(-1, 1, s) / np.sqrt(s[0]) for s in shapes]
    learns, judges = part == "train", part == "validation"
    sizes = np.maximum(np.bincount(y[learns], minlength=2), 1)
    importance = learns * (sizes.sum() / (2 * sizes))[y]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    best = Network(kind, [w.copy() for w in weights], 0, -1.0)
    for epoch in range(1, EPOCHS + 1):
        mask = (rng.random((len(x), HIDDEN)) >= DROPOUT) / (1 - DROPOUT)
        _, grads = gradients(kind, weights, hood, x, y, importance, mask)
        for i, g in enumerate(grads):
            g = g + DECAY * weights[i]
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.999**epoch)) + 1e-8)
        f1 = _f1(y[judges], forward(kind, weights, hood, x)[0].argmax(axis=1)[judges])
        if f1 > best.validation_f1:
            best = Network(kind, [w.copy() for w in weights], epoch, f1)
        elif epoch - best.epochs >= PATIENCE:
            break
    return best


def neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source, target) both ways between known nodes, with a loop for each node."""
    ends = edges.select(F.inline(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))))
    known = nodes.select("node_id")
    inside = ends.join(known.withColumnRenamed("node_id", "source"), "source", "left_semi").join(known.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return inside.unionByName(known.select(F.col("node_id").alias("source"), F.col("node_id").alias("target"))).distinct()


def standardised(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``x``: columns by mean and deviation of the train part, clipped to 8 either way; null and not a number give 0."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    one = nodes.where("part = 'train'").agg(*[f(known[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [F.coalesce(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (known[c] - F.lit(one[f"m{i}"])) / F.lit(one[f"s{i}"] or 1.0))), F.lit(0.0)) for i, c in enumerate(columns)]
    return nodes.withColumn("x", F.array(*scaled))


def sample(nodes: DataFrame, hood: DataFrame, bound: int = SAMPLE_NODES) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nodes of train and validation groups with the smallest hashes, at most ``bound``, and the edges between them."""
    known = nodes.where("part <> 'test' AND y IS NOT NULL")
    share = bound / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64("group", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    held = drawn.orderBy(F.xxhash64("group"), F.xxhash64("node_id")).limit(bound).select("node_id", "x", "y", "part").toPandas()  # bounded
    ids = nodes.sparkSession.createDataFrame(held[["node_id"]], nodes.select("node_id").schema)
    ends = hood.where("source <> target").join(F.broadcast(ids.withColumnRenamed("node_id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("node_id", "target")), "target", "left_semi")
    return held, ends.orderBy(F.xxhash64("source", "target")).limit(SAMPLE_DEGREE * bound).toPandas()


def scores(networks: Sequence[Network], nodes: DataFrame, hood: DataFrame) -> DataFrame:
    """(node_id, score_0, score_1, ...): probability of class 1 of every node by each network.

    All networks share one join and one aggregate a layer.  The first sums the features of a neighbourhood, plain
    and by the root of the degree; the second sums one number for each network, since its weights are applied to a
    node before it is sent, and only the difference of both classes counts.
    """
    degree = hood.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    values = staged(nodes.select("node_id", "x").join(degree, "node_id"))
    size = len(networks[0].weights[0]) - 1
    sent = values.select(F.col("node_id").alias("source"), "x", (1 / F.sqrt("degree")).alias("w"))
    near = [f(F.get("x", F.lit(i))) for f in (lambda v: F.sum(v), lambda v: F.sum(v * F.col("w"))) for i in range(size)]
    sums = hood.join(sent, "source").groupBy(F.col("target").alias("node_id")).agg(F.array(*near[:size], F.count(F.lit(1)).cast("double")).alias("plain"), F.array(*near[size:], F.sum("w")).alias("rooted"))
    weights = [(n.kind == "sage", *n.weights) for n in networks]

    @F.pandas_udf("array<double>")
    def first(x: pd.Series, degree: pd.Series, plain: pd.Series, rooted: pd.Series) -> pd.Series:
        """For each network: what the node sends, and what it keeps."""
        if not len(x):
            return pd.Series([], dtype=object)
        own, n = _ones(np.stack(x.to_numpy())), degree.to_numpy(float)[:, None]
        mean, rooted, out = np.stack(plain.to_numpy()) / n, np.stack(rooted.to_numpy()) / np.sqrt(n), []
        for sage, own1, near1, own2, near2 in weights:
            h = _ones(np.maximum(mean @ near1 + own @ own1 if sage else rooted @ near1, 0))
            send, keep = h @ (near2[:, 1] - near2[:, 0]), h @ (own2[:, 1] - own2[:, 0])
            out += [send, keep] if sage else [send / np.sqrt(n[:, 0]), 0 * keep]
        return pd.Series(list(np.column_stack(out)))

    hidden = staged(values.join(sums, "node_id").select("node_id", "degree", first("x", "degree", "plain", "rooted").alias("h")))
    met = hood.join(hidden.select(F.col("node_id").alias("source"), "h"), "source").groupBy(F.col("target").alias("node_id"))
    last = hidden.join(met.agg(*[F.sum(F.col("h")[2 * i]).alias(f"s{i}") for i in range(len(networks))]), "node_id")
    post = [1 / F.col("degree") if n.kind == "sage" else 1 / F.sqrt("degree") for n in networks]
    return last.select("node_id", *[(1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -(F.col(f"s{i}") * post[i] + F.col("h")[2 * i + 1])))))).alias(f"score_{i}") for i in range(len(networks))])


def score(network: Network, nodes: DataFrame, hood: DataFrame) -> DataFrame:
    """(node_id, score): probability of class 1 of every node."""
    return scores([network], nodes, hood).withColumnRenamed("score_0", "score")


def graph_networks(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], kinds: Sequence[str] = KINDS) -> DataFrame:
    """Metrics on the test part of both networks, with the size of the sample, best epoch and its F1.

    ``nodes`` has node_id, group, part (train, validation, test), y (0, 1 or null: not judged) and the
    columns; edges to unknown nodes are left out.  Without train or test rows a row says so.
    """
    spark = nodes.sparkSession
    nodes = staged(standardised(nodes, columns).select("node_id", "group", "part", F.col("y").cast("int").alias("y"), "x"))
    hood = staged(neighbourhood(nodes, edges))
    held, ends = sample(nodes, hood)
    if not (held["part"] == "train").any() or nodes.where("part = 'test' AND y IS NOT NULL").isEmpty():
        return spark.createDataFrame([(k, "skipped: no rows to train or test") for k in kinds], "model_name string, training_status string")
    place = pd.Series(np.arange(len(held)), index=held["node_id"])
    loops = np.arange(len(held))
    source, target = (np.concatenate([place[ends[c]].to_numpy(int), loops]) for c in ("source", "target"))
    out, x = None, np.stack(held["x"].to_numpy())
    trained = [train(kind, x, held["y"].to_numpy(int), held["part"].to_numpy(), source, target) for kind in kinds]
    both = staged(scores(trained, nodes, hood).join(nodes.where("part = 'test' AND y IS NOT NULL").select("node_id", "y"), "node_id"))
    for i, (kind, network) in enumerate(zip(kinds, trained)):
        judged = both.select("node_id", "y", F.col(f"score_{i}").alias("score"), (F.col(f"score_{i}") > 0.5).cast("int").alias("prediction"))
        areas = evaluation.roc_auc(judged, "y", "score").crossJoin(evaluation.average_precision(judged, "y", "score"))  # one row each
        row = evaluation.classification_metrics(judged, "y", "prediction").crossJoin(areas).withColumns({
            "model_name": F.lit(kind), "training_status": F.lit("ok"), "trained_nodes": F.lit(int((held["part"] == "train").sum())), "best_epoch": F.lit(network.epochs), "validation_f1": F.lit(round(network.validation_f1, 6)),
        })
        out = row if out is None else out.unionByName(row)
    return out
