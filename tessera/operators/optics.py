"""OPTICS: an order of rows by reachability, and clusters where its plot falls and rises steeply.

The order is sequential by definition, so it is made on a bounded sample in hash order (``density.SAMPLE``
rows); every least number of neighbours is a task of its own.  Every other row of the table then joins
its nearest row of the sample, by a pass over the table to which only the sample travels.

Null vectors get no position and cluster -1.  Equal vectors are at distance 0 of each other and come in the
order of their ids.  With fewer rows than ``least`` nothing is dense: all core distances are infinite and all
rows noise.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.clustering import valid_partition
from tessera.operators.density import SAMPLE, partition_scores
from tessera.operators.metric import distances

#: Least neighbours, steepness, and least share and number of a cluster's rows (fixed values).
LEAST = [10, 25, 50, 100]
XI, SHARE, SMALLEST = 0.05, 0.02, 25


def reachability_order(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, and for each row (not each place) core distance, reachability and the row that gave it (-1: none).

    Always the open row with the smallest reachability is next, the first of equal ones.
    """
    n = len(x)
    core, reach, giver = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)
    if n >= least:
        for i in range(0, n, 512):
            core[i : i + 512] = np.partition(distances(x[i : i + 512], x), least - 1, axis=1)[:, least - 1]
    order, open_ = np.empty(n, dtype=int), np.ones(n, dtype=bool)
    for place in range(n):
        at = int(np.where(open_, reach, np.inf).argmin())
        if not open_[at]:  # all open rows are out of reach
            at = int(open_.argmax())
        order[place], open_[at] = at, False
        if np.isfinite(core[at]):
            offer = np.maximum(distances(x[at : at + 1], x)[0], core[at])
            better = open_ & (offer < reach)
            reach[better], giver[better] = offer[better], at
    return order, core, reach, giver


def steep_areas(plot: np.ndarray, least: int, xi: float) -> list[tuple[int, int, bool]]:
    """(first, last, falls) of the steep areas of a plot that ends with infinity, by first place.

    Place i is steep where the plot changes by the factor 1 - xi or more on the way to i + 1.  An area starts
    and ends with steep places of one direction, never turns back, and holds at most ``least`` places in a
    row that are not steep.
    """
    out, here, after = [], plot[:-1], plot[1:]
    for falls in (True, False):
        big, small = (here, after) if falls else (after, here)
        steep = (big * (1 - xi) >= small) & (big > small)
        turns = big < small
        i = 0
        while i < len(here):
            if not steep[i]:
                i += 1
                continue
            first = last = i
            j, flat = i + 1, 0
            while j < len(here) and not turns[j]:
                flat = 0 if steep[j] else flat + 1
                if flat > least:
                    break
                last = j if steep[j] else last
                j += 1
            out.append((first, last, falls))
            i = last + 1
    return sorted(out)


def xi_clusters(plot: np.ndarray, givers: np.ndarray, least: int, smallest: int, xi: float = XI) -> list[tuple[int, int]]:
    """(first, last) places of the clusters between a steep fall and a later steep rise, inner ones before those around them.

    ``plot`` has one reachability for each place, ``givers`` the place that gave it (-1: none).  The highest place
    between the fall and the rise has to lie below both their ends by the factor 1 - xi.  The end of a
    cluster is drawn in until the last row was reached from inside it or lies below the first.
    """
    plot = np.append(plot, np.inf)
    keep = 1 - xi
    found: list[tuple[int, int]] = []
    open_falls: list[list] = []  # first and last place of a fall, highest place since it
    highest, seen = 0.0, 0
    for first, last, falls in steep_areas(plot, least, xi):
        if first < seen:  # inside the area before
            continue
        highest = max(highest, plot[seen : first + 1].max())
        open_falls = [[a, b, max(top, highest)] for a, b, top in open_falls if np.isfinite(highest) and plot[a] * keep >= highest]
        seen, highest = last + 1, plot[last + 1] if last + 1 < len(plot) else np.inf
        if falls:
            open_falls.append([first, last, 0.0])
            continue
        inner = []
        for a, b, top in open_falls:
            after = plot[last + 1]
            if top > after * keep:
                continue
            start, end = a, last
            if plot[a] * keep >= after:  # the fall starts higher than the rise ends
                while start < b and plot[start + 1] > after:
                    start += 1
            elif after * keep >= plot[a]:  # the rise ends higher
                while end > first and plot[end - 1] > plot[a]:
                    end -= 1
            while end > start and plot[end] >= plot[start] and not start <= givers[end] < end:
                end -= 1
            if end - start + 1 >= smallest and start <= b and end >= first:
                inner.append((start, end))
        found += inner[::-1]
    return found


def leaf_labels(clusters: Sequence[tuple[int, int]], n: int) -> np.ndarray:
    """A number for each place, -1 outside: a cluster that holds a labelled place gets none."""
    label, count = np.full(n, -1), 0
    for first, last in clusters:
        if (label[first : last + 1] < 0).all():
            label[first : last + 1] = count
            count += 1
    return label


def fitted(x: np.ndarray, least: int, xi: float = XI, smallest: int | None = None) -> pd.DataFrame:
    """at, place, core, reach, cluster for the rows of a matrix."""
    smallest = max(SMALLEST, round(SHARE * len(x))) if smallest is None else smallest
    order, core, reach, giver = reachability_order(x, least)
    place = np.empty(len(x), dtype=int)
    place[order] = np.arange(len(x))
    givers = np.where(giver[order] < 0, -1, place[giver[order]])
    label = leaf_labels(xi_clusters(reach[order], givers, least, smallest, xi), len(x))
    return pd.DataFrame({"at": np.arange(len(x)), "place": place, "core": core, "reach": reach, "cluster": label[place]})


def _sample(df: DataFrame, key: str, vector: str, rows: int) -> tuple[list, np.ndarray]:
    held = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    found = held.orderBy(F.xxhash64("v"), "v", "k").limit(rows).toPandas()
    return found["k"].tolist(), np.stack(found["v"].to_numpy()) if len(found) else np.zeros((0, 0))


def _fits(df: DataFrame, x: np.ndarray, least: Sequence[int], xi: float, smallest: int | None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in pdf["least"]:
                yield fitted(x, int(k), xi, smallest).assign(least=int(k))[["least", "at", "place", "core", "reach", "cluster"]]

    asked = df.sparkSession.createDataFrame([(k,) for k in least], "least int").repartition(len(least))
    return asked.mapInPandas(run, "least int, at int, place int, core double, reach double, cluster int")


def optics(df: DataFrame, key: str, vector: str, least: Sequence[int] = LEAST, xi: float = XI, smallest: int | None = None, rows: int = SAMPLE) -> DataFrame:
    """One row for each row of ``df`` and each of ``least``: key, least, place, core_distance, reachability, cluster, sampled.

    Rows outside the sample have the place of their nearest row of it and its core distance; their reachability
    is the distance to it, at least that core distance.  They belong to its cluster if they lie within its core
    distance, else they are noise.  Infinite distances are null.
    """
    keys, x = _sample(df, key, vector, rows)
    spark, kind = df.sparkSession, df.schema[key].dataType
    wide = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                side = part.column("v")
                known = ~np.asarray(side.is_null().to_numpy(zero_copy_only=False), dtype=bool)
                at, apart = np.full(len(side), -1), np.full(len(side), np.inf)
                if known.any() and len(x):
                    d = distances(side.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1), x)
                    at[known] = d.argmin(axis=1)
                    apart[known] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(at.astype(np.int32)), pa.array(apart)], names=["k", "at", "apart"])

    near = wide.mapInArrow(attach, f"k {kind.simpleString()}, at int, apart double")
    marks = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind.simpleString()}, own int")  # at most ``rows``
    each = near.join(F.broadcast(marks), "k", "left").withColumn("at", F.coalesce("own", "at")).withColumn("least", F.explode(F.array(*[F.lit(k) for k in least])))
    fits = _fits(df, x, least, xi, smallest)  # at most ``rows`` for each of ``least``
    both = each.join(F.broadcast(fits), ["least", "at"], "left")
    sampled = F.col("own").isNotNull()
    finite = lambda c: F.when(c < float("inf"), c)
    return both.select(
        F.col("k").alias(key), "least", "place",
        finite(F.col("core")).alias("core_distance"),
        finite(F.when(sampled, F.col("reach")).otherwise(F.greatest("apart", "core"))).alias("reachability"),
        F.when(sampled | (F.col("apart") <= F.col("core")), F.coalesce("cluster", F.lit(-1))).otherwise(-1).alias("cluster"),
        sampled.alias("sampled"),
    )


def optics_sweep(df: DataFrame, vector: str, least: Sequence[int] = LEAST, xi: float = XI, smallest: int | None = None, rows: int = SAMPLE) -> DataFrame:
    """One row for each of ``least``: the partition of the bounded sample, its scores and whether it is valid."""
    _, x = _sample(df.withColumn("_none", F.lit(0)), "_none", vector, rows)
    names = "least int, clusters int, noise_fraction double, smallest_fraction double, silhouette double, valid boolean"
    if not len(x):
        return df.sparkSession.createDataFrame([], names)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(int(k), partition_scores(x, fitted(x, int(k), xi, smallest)["cluster"].to_numpy())) for k in pdf["least"]]
            yield pd.DataFrame([(k, *f, valid_partition(*f)) for k, f in found], columns=[n.split()[0] for n in names.split(", ")])

    return df.sparkSession.createDataFrame([(k,) for k in least], "least int").repartition(len(least)).mapInPandas(score, names)
