"""Ward's hierarchical clustering: linked on a bounded sample, other rows join the nearest centre."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that are linked, as in the catalogue that this follows.
SAMPLE = 5_000


def merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (cost, row of one cluster, row of the other) in ascending cost, by chains of nearest neighbours.

    Only centres and sizes are held, so memory grows with the rows, not with their square.
    """
    centres, sizes, found, chain = x.astype(float), np.ones(len(x)), [], []
    while len(found) < len(x) - 1:
        if not chain:
            chain.append(int(np.flatnonzero(sizes)[0]))
        i = chain[-1]
        cost = np.where(sizes > 0, sizes[i] * sizes / (sizes[i] + sizes) * ((centres - centres[i]) ** 2).sum(axis=1), np.inf)
        cost[i] = np.inf
        j = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
            j = chain[-2]
            found.append((float(cost[j]), i, j))
            centres[j] = (sizes[i] * centres[i] + sizes[j] * centres[j]) / (sizes[i] + sizes[j])
            sizes[j], sizes[i] = sizes[i] + sizes[j], 0
            del chain[-2:]
        else:
            chain.append(j)
    return sorted(found, key=lambda m: m[0])


def ward(df: DataFrame, key: str, vector: str, k: int, bound: int = SAMPLE) -> DataFrame:
    """(key, cluster) of at most ``bound`` rows in hash order, clusters numbered by their smallest key.

    Null vectors are left out; with fewer rows than ``k`` each row is a cluster.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    held = rows.orderBy(F.xxhash64("key"), "key").limit(bound).toPandas().sort_values("key")  # bounded
    root = np.arange(len(held))
    for _, i, j in merges(np.stack(held["v"].to_numpy()))[: max(0, len(held) - k)] if len(held) else []:
        a, b = sorted((root[i], root[j]))
        root[root == b] = a
    labels = np.unique(root, return_inverse=True)[1]
    return df.sparkSession.createDataFrame([(int(n), int(c)) for n, c in zip(held["key"], labels)], f"`{key}` long, cluster int")


def ward_all(df: DataFrame, key: str, vector: str, k: int, bound: int = SAMPLE) -> DataFrame:
    """(key, cluster) of every row: those of the sample as linked, others by the nearest centre (ties: the first), null vectors null.

    Keys must be unique and vectors of one length.
    """
    linked = ward(df, key, vector, k, bound)
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    centres = rows.join(F.broadcast(linked), key).select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("c")).toPandas().sort_values(["cluster", "d"])  # k vectors
    if centres.empty:
        return rows.select(key, F.lit(None).cast("int").alias("cluster"))
    square = lambda c: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    nearest = F.array_min(F.array(*[F.struct(square(part["c"]).alias("d"), F.lit(int(c)).alias("cluster")) for c, part in centres.groupby("cluster")]))["cluster"]
    return rows.join(F.broadcast(linked), key, "left").select(key, F.when(F.col("v").isNotNull(), F.coalesce("cluster", nearest)).alias("cluster"))
