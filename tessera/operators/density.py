"""Parameters for density clustering: distances to the k-th neighbour, radii taken from them, and a sweep over both."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metric
from tessera.operators.clustering import valid_partition
from tessera.operators.quantiles import summary
from tessera.operators.staging import staged

#: Rows of a density sample, neighbours and quantiles of a sweep (fixed values).
SAMPLE = 4000
MIN_SAMPLES = [10, 25, 50, 100]
QUANTILES = [0.70, 0.80, 0.85, 0.90, 0.95, 0.97, 0.99]


def sampled(df: DataFrame, vector: str, rows: int = SAMPLE, copies: str | None = None) -> np.ndarray:
    """At most ``rows`` vectors in hash order, one for each row of the matrix; null vectors are left out, and a row stands for ``copies``."""
    each = F.lit(1) if copies is None else F.col(copies)
    held = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), each.cast("long").alias("n"))
    found = held.orderBy(F.xxhash64("v"), "v").limit(rows).toPandas()
    if not len(found):
        return np.zeros((0, 0))
    ends = found["n"].cumsum().to_numpy()
    return np.stack(found["v"].to_numpy())[np.searchsorted(ends, np.arange(min(rows, ends[-1])), side="right")]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None, :], 0)


def k_distances(df: DataFrame, vector: str, ks: Sequence[int] = MIN_SAMPLES, rows: int | None = None) -> DataFrame:
    """(k, at, distance, copies): from each vector to its k-th nearest of all rows, itself included, and the rows that it stands for.

    Every distinct vector is asked for; only pairs of blocks of a metric index that may hold its nearest are compared.
    With ``rows``, those of a sample of so many are, each for itself: every task streams its rows past the sample and
    keeps the nearest of each, which are merged.  With fewer rows than k, the farthest counts.
    """
    if rows is None:
        return _all_k_distances(df, vector, ks)
    asked, most = sampled(df, vector, rows), max(ks)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(asked), 0))
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                side = batch.column("v").slice(i, 2048)
                x = side.flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)
                held = np.concatenate([held, _squares(asked, x)], axis=1)
                held = np.partition(held, most - 1, axis=1)[:, :most] if held.shape[1] > most else held
        if held.size:
            ends = pa.array(np.arange(len(asked) + 1, dtype=np.int32) * held.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.ListArray.from_arrays(ends, pa.array(np.sqrt(held).ravel()))], names=["at", "near"])

    rows_of = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    merged = rows_of.mapInArrow(nearest, "at long, near array<double>").groupBy("at").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    each = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return merged.select("at", "near", each).select("k", "at", F.element_at("near", F.least("k", F.size("near"))).alias("distance"), F.lit(1).cast("long").alias("copies"))


def _all_k_distances(df: DataFrame, vector: str, ks: Sequence[int]) -> DataFrame:
    most = max(ks)
    counted = staged(df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array_repeat(F.lit(True), F.least(F.col("n"), F.lit(most)).cast("int"))).alias("each")  # copies beyond the largest k are never among the nearest
    points = metric.build(counted.select("v", each).select("v"), [])
    asked = metric.build(counted, ["n"], points.pivots)
    slack = max(points.slack, asked.slack)

    def nearest(pairs: Iterator[tuple[metric.Side, metric.Side]]) -> Iterator[pa.RecordBatch]:
        """The squares of the nearest distances in a tile of each asked row; a block without rows that could be nearer is left out."""
        side, near, done = None, None, np.inf

        def out() -> pa.RecordBatch:
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(near), side.block)), pa.array(np.arange(len(near), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(np.sqrt(near).ravel()))], names=["block", "at", "near"])

        for q, other in pairs:
            if side is None or side.block != q.block:
                if side is not None:
                    yield out()
                side, near, done = q, np.zeros((len(q.x), 0)), np.inf
            if q.apart <= done:
                near = np.concatenate([near, _squares(q.x, other.x)], axis=1)
                near = np.partition(near, most - 1, axis=1)[:, :most] if near.shape[1] > most else near
                done = float(np.sqrt(near.max())) + slack if near.shape[1] == most else np.inf
        if side is not None:
            yield out()

    found = metric.nearest(asked, points, most, nearest, "block long, at int, near array<double>")
    merged = found.groupBy("block", "at").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    rows = asked.blocks.select("block", F.posexplode("rows").alias("at", "row")).join(merged, ["block", "at"])
    at = (F.col("block") * F.lit(metric.ROWS) + F.col("at")).alias("at")
    held = staged(rows.select(at, F.col("row.n").alias("copies"), F.array(*[F.struct(F.lit(k).alias("k"), F.element_at("near", F.least(F.lit(k), F.size("near"))).alias("distance")) for k in ks]).alias("x")))
    return held.select("at", "copies", F.inline("x")).select("k", "at", "distance", "copies")


def eps_candidates(distances: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(k, quantile, eps): positive quantiles of each k's distances, to four places."""
    cuts = {f"q{i}": q for i, q in enumerate(quantiles)}
    found = summary(distances, ["k"], "distance", cuts, "copies").select("k", F.inline(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(c).alias("eps")) for c, q in cuts.items()])))
    return found.withColumn("eps", F.round("eps", 4)).where("eps > 0")


def density_labels(near: np.ndarray, least: int) -> np.ndarray:
    """DBSCAN's labels (noise -1) from a matrix of neighbourhoods."""
    core, label, count = near.sum(axis=1) >= least, np.full(len(near), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            front = np.array([i])
            while len(front):
                label[front] = count
                reached = np.flatnonzero(near[front[core[front]]].any(axis=0) & (label < 0))
                front = reached
            count += 1
    return label


def partition_scores(x: np.ndarray, label: np.ndarray) -> tuple[int, float, float, float | None]:
    """Clusters, share of noise, smallest cluster's share of all rows, mean silhouette of the clustered rows."""
    kept = label >= 0
    sizes = np.bincount(label[kept])
    if not len(sizes):
        return 0, 1.0, 0.0, None
    if len(sizes) < 2:
        return 1, float(1 - kept.mean()), float(sizes.min() / len(x)), None
    of = label[kept]
    d = np.sqrt(_squares(x[kept], x[kept]))
    np.fill_diagonal(d, 0)
    sums = d @ np.eye(len(sizes))[of]
    own, at = sizes[of], np.arange(len(of))
    a = sums[at, of] / np.maximum(own - 1, 1)
    means = sums / sizes
    means[at, of] = np.inf
    b = means.min(axis=1)
    silhouette = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return len(sizes), float(1 - kept.mean()), float(sizes.min() / len(x)), float(silhouette.mean())


def density_sweep(df: DataFrame, vector: str, ks: Sequence[int] = MIN_SAMPLES, quantiles: Sequence[float] = QUANTILES, rows: int = SAMPLE) -> DataFrame:
    """DBSCAN of a bounded sample for every radius and every least number of neighbours: scores and whether the partition is valid.

    Radii are quantiles of the sample's own k-distances; each setting is a task of its own.
    """
    x, spark = sampled(df, vector, rows), df.sparkSession
    names = "eps double, min_samples int, clusters int, noise_fraction double, smallest_fraction double, silhouette double, valid boolean"
    if not len(x):
        return spark.createDataFrame([], names)
    inner = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")  # the sample alone
    eps = sorted({r["eps"] for r in eps_candidates(k_distances(inner, "v", ks, rows), quantiles).select("eps").collect()})  # at most len(ks) * len(quantiles)
    settings = [(e, k) for e in eps for k in ks]
    if not settings:
        return spark.createDataFrame([], names)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = None
        for pdf in frames:
            squares = _squares(x, x) if squares is None else squares
            out = []
            for e, k in zip(pdf["eps"], pdf["min_samples"]):
                found = partition_scores(x, density_labels(squares <= e * e + 1e-12, k))
                out.append((e, k, *found, valid_partition(*found)))
            yield pd.DataFrame(out, columns=["eps", "min_samples", "clusters", "noise_fraction", "smallest_fraction", "silhouette", "valid"])

    return spark.createDataFrame(settings, "eps double, min_samples int").repartition(min(len(settings), 16)).mapInPandas(score, names)


def best_setting(sweep: DataFrame) -> DataFrame:
    """The valid partition with the highest silhouette, then the smaller radius; no row where none is valid."""
    return sweep.where("valid").orderBy(F.desc("silhouette"), "eps", "min_samples").limit(1)
