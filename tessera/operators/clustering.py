"""Clusterings and what tells them apart: validity indices, profiles, effects, resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import quantiles
from tessera.operators.running import numbered
from tessera.operators.staging import staged

#: Decimals of a session's standardised numbers that count.
DIGITS = 9


def kmeans(df: DataFrame, features: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` from MLlib's k-means on a vector column."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def bisecting(df: DataFrame, features: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` from bisecting k-means, the scalable hierarchical method."""
    from pyspark.ml.clustering import BisectingKMeans

    return BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def mixture(df: DataFrame, features: str, k: int, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Adds ``cluster`` from a Gaussian mixture, with BIC and AIC of the fit (full covariances)."""
    from pyspark.ml.clustering import GaussianMixture

    model = GaussianMixture(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    n, d = df.count(), len(model.gaussians[0].mean)
    free, log = k - 1 + k * d + k * d * (d + 1) / 2, model.summary.logLikelihood
    return model.transform(df), {"bic": free * float(np.log(n)) - 2 * log, "aic": 2 * free - 2 * log}


def projection(df: DataFrame, vector: str, components: int = 2) -> DataFrame:
    """Adds ``projection``: the first principal components of an array column.

    Tasks add up products of their rows, so the driver gets one square of the vector's length; each
    component points to where its largest entry is positive.  Null vectors give null.
    """

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if sums.empty:
        return df.withColumn("projection", F.lit(None).cast("array<double>"))
    d = int(sums["i"].max()) + 1
    full = np.zeros((d, d))
    full[sums["i"], sums["j"]] = sums["s"]
    n, mean = full[0, 0], full[0, 1:] / full[0, 0]
    _, axes = np.linalg.eigh(full[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    dot = lambda w: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) - float(mean @ w)
    return df.withColumn("projection", F.when(F.col(vector).isNotNull(), F.array(*[dot(w) for w in axes.T])))


def relabel(df: DataFrame, cluster: str, outcome: str) -> DataFrame:
    """Clusters numbered from 0 by ascending outcome rate; noise (-1) keeps its number."""
    rates = df.where(F.col(cluster) >= 0).groupBy(cluster).agg((F.sum(F.col(outcome).cast("long")) / F.count(F.lit(1))).alias("r"))
    new = rates.select(cluster, (F.row_number().over(Window.partitionBy().orderBy("r", cluster)) - 1).alias("_new"))  # one row for each cluster
    return df.join(new, cluster, "left").withColumn(cluster, F.coalesce("_new", F.lit(-1))).drop("_new")


def _dims(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return df.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def dispersion(df: DataFrame, cluster: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(cluster, d, centroid) and (cluster, size, within: sum of squares) of an array column."""
    stats = _dims(df, cluster, vector).groupBy("cluster", "d").agg(F.avg("x").alias("centroid"), F.count(F.lit(1)).alias("size"), (F.var_pop("x") * F.count(F.lit(1))).alias("within"))
    return stats.select("cluster", "d", "centroid"), stats.groupBy("cluster").agg(F.max("size").alias("size"), F.sum("within").alias("within"))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Ratio of between and within dispersion, each over its degrees of freedom."""
    stats = _dims(df, cluster, vector).groupBy("cluster", "d").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"), (F.var_pop("x") * F.count(F.lit(1))).alias("w"))
    overall = stats.groupBy("d").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("m"))
    sums = stats.join(overall, "d").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("m"), 2)).alias("between"), F.sum("w").alias("within"))
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("k"))
    value = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.crossJoin(sizes).select(F.col("k").alias("clusters"), F.round(F.when((F.col("k") > 1) & (F.col("within") > 0), value), 6).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centroid distance."""
    centres = _dims(df, cluster, vector).groupBy("cluster", "d").agg(F.avg("x").alias("c"))
    # One row for each cluster, so distances to centres are sums inside the row.
    packed = centres.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda p: p["c"]).alias("centre"))
    square = F.aggregate(F.zip_with(F.col("v"), F.col("centre"), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    spread = df.select(F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("v")).join(packed, "cluster").groupBy("cluster").agg(F.avg(F.sqrt(square)).alias("s"))
    other = centres.select(F.col("cluster").alias("other"), "d", F.col("c").alias("o"))
    apart = centres.join(other, "d").where("cluster <> other").groupBy("cluster", "other").agg(F.sqrt(F.sum(F.pow(F.col("c") - F.col("o"), 2))).alias("m"))
    worst = apart.join(spread, "cluster").join(spread.select(F.col("cluster").alias("other"), F.col("s").alias("so")), "other").groupBy("cluster").agg(F.max((F.col("s") + F.col("so")) / F.col("m")).alias("w"))
    return worst.agg(F.round(F.avg("w"), 6).alias("davies_bouldin"))


def silhouette(df: DataFrame, features: str, cluster: str) -> float:
    """Mean Euclidean silhouette of a labelling of vectors, on all rows."""
    from pyspark.ml.functions import vector_to_array

    from tessera.operators import centres

    return centres.silhouette(df.select(vector_to_array(features).alias("v"), cluster), "v", [cluster])[cluster]


def profile(df: DataFrame, cluster: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Long profile: size, means and medians of numbers; modes and their share of all rows of the cluster (nulls included)."""
    numbers = df.select(F.col(cluster).alias("cluster"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric])))
    counts = staged(numbers.groupBy("cluster", "feature", "x").agg(F.count(F.lit(1)).alias("c")))
    middle = quantiles.summary(counts, ["cluster", "feature"], "x", {"median": 0.5}, "c").alias("m")
    sizes = counts.groupBy("cluster", "feature").agg(F.sum("c").alias("size")).alias("s")
    both = sizes.join(middle, F.col("s.cluster").eqNullSafe(F.col("m.cluster")) & (F.col("s.feature") == F.col("m.feature")), "left")
    first = both.select("s.cluster", "s.feature", "s.size", F.round("m.mean", 6).alias("mean"), "m.median")
    texts = df.select(F.col(cluster).alias("cluster"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in categorical])))
    counts = texts.groupBy("cluster", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cluster", "feature").agg(F.sum("n").alias("size"), F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))).alias("b"))
    second = best.select("cluster", "feature", "size", F.col("b.v").alias("mode"), (-F.col("b.n") / F.col("size")).alias("mode_fraction"))
    return first.unionByName(second, allowMissingColumns=True)


def effect_sizes(df: DataFrame, cluster: str, numeric: Sequence[str]) -> DataFrame:
    """Standardised mean difference of clusters 1 and 0, with pooled deviation."""
    long = df.select(F.col(cluster).alias("c"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in numeric])))
    side = lambda k: [F.avg(F.when(F.col("c") == k, F.col("x"))).alias(f"m{k}"), F.var_samp(F.when(F.col("c") == k, F.col("x"))).alias(f"v{k}"), F.count(F.when(F.col("c") == k, F.col("x"))).alias(f"n{k}")]
    stats = long.groupBy("metric").agg(*side(0), *side(1))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return stats.select("metric", F.col("n0").alias("n_0"), F.col("n1").alias("n_1"), F.round(F.col("m1") - F.col("m0"), 6).alias("mean_difference"), F.round(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled), 6).alias("standardised_difference"))


def risk_ratio(df: DataFrame, cluster: str, outcome: str) -> DataFrame:
    """Outcome rates of clusters 0 and 1, their difference and ratio."""
    rate = lambda k: F.sum(F.when(F.col(cluster) == k, F.col(outcome).cast("long"))) / F.count_if(F.col(cluster) == k)
    one = df.agg(rate(0).alias("rate_0"), rate(1).alias("rate_1"))
    return one.select("rate_0", "rate_1", (F.col("rate_1") - F.col("rate_0")).alias("risk_difference"), F.when(F.col("rate_0") > 0, F.col("rate_1") / F.col("rate_0")).alias("risk_ratio"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    table = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: n * (n - 1) / 2
    cells = table.agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    one = cells.crossJoin(rows).crossJoin(cols)
    expected, most = F.col("rows") * F.col("cols") / two(F.col("total")), (F.col("rows") + F.col("cols")) / 2
    return one.select(F.round(F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / (most - expected)), 9).alias("adjusted_rand_index"))


def poisson_weights(keys: np.ndarray, repetitions: int, seed: int) -> np.ndarray:
    """(repetitions, rows): Poisson counts of mean 1 by inverting a hash of row and repetition."""
    with np.errstate(over="ignore"):
        z = keys[None, :] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(repetitions, dtype=np.uint64)[:, None] + np.uint64(seed << 20)) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))).astype(float) / 2.0**64
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(20), 1))), u, side="right")


def bootstrap_means(df: DataFrame, cluster: str, metric: str, repetitions: int = 300, seed: int = 42, key: str | None = None) -> DataFrame:
    """Percentile interval of cluster means by Poisson bootstrap: each task adds weighted sums for all repetitions, which a sum combines.

    A row's weights follow from its own hash, so the interval depends neither on batches nor on partitions.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for c, part in pdf.groupby("c"):
                x = part["x"].to_numpy(float)
                w = poisson_weights(part["h"].to_numpy().astype(np.uint64), repetitions, seed)
                held[c] = held.get(c, 0) + np.stack([w @ x, w.sum(axis=1)])
        for c, t in held.items():
            yield pd.DataFrame({"cluster": c, "r": np.arange(repetitions), "s": t[0], "n": t[1]})

    keys = F.xxhash64(*df.columns) if key is None else F.xxhash64(key)
    rows = df.select(F.col(cluster).cast("int").alias("c"), F.col(metric).cast("double").alias("x"), keys.alias("h")).where("x IS NOT NULL")
    means = rows.mapInPandas(sums, "cluster int, r int, s double, n double").groupBy("cluster", "r").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.groupBy("cluster").agg(F.percentile("m", 0.025).alias("ci_low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("ci_high"))


def permutation_gap(df: DataFrame, cluster: str, outcome: str, repetitions: int = 1000, seed: int = 42) -> DataFrame:
    """Gap between the highest and lowest cluster rate against random assignment: observed, null 95 %, p.

    Given all sizes, positives fall on clusters by a multivariate hypergeometric law, so repetitions
    are drawn from cluster sizes alone and no row is shuffled.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("k")).toPandas()
    n, k = sizes["n"].to_numpy(), sizes["k"].to_numpy()
    observed = float((k / n).max() - (k / n).min()) if len(n) else 0.0

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            gaps = []
            for r in pdf["id"]:
                hits = np.random.default_rng([seed, int(r)]).multivariate_hypergeometric(n, int(k.sum()), method="marginals") / n
                gaps.append(hits.max() - hits.min())
            yield pd.DataFrame({"gap": gaps})

    null = df.sparkSession.range(repetitions).mapInPandas(draw, "gap double")
    return null.agg(F.lit(observed).alias("observed_gap"), F.percentile("gap", 0.95).alias("null_p95"), ((F.count_if(F.col("gap") >= observed) + 1) / (F.lit(repetitions) + 1)).alias("p_value"))


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_samples: int, bound: int | None = None) -> DataFrame:
    """DBSCAN of every row (noise -1), clusters numbered by their smallest core key, borders in the first cluster that reaches them.

    Distinct vectors go into a metric index.  Rows that find enough neighbours in their own block are core
    at once; only the others are counted against the blocks that may reach them.  Core rows are linked
    inside each block first, so a pair of blocks has only to tell which of their parts touch: its rows do not
    grow with the rows of the blocks.  Keys must be unique; a null vector is noise.  With ``bound``, more
    rows raise.
    """
    from tessera.operators import graphs, metric

    if bound is not None and df.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} rows")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    points = metric.build(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("m")), ["id", "m"])
    limit = eps * eps + 1e-12

    def inside(batches):
        """Weighted neighbours in the own block."""
        for batch in batches:
            for side in (batch.column("rows")[i].values for i in range(batch.num_rows)):
                x = metric.matrix(side)
                n = (metric.squares(x, x) <= limit) @ side.field("m").to_numpy().astype(float)
                yield pa.RecordBatch.from_arrays([side.field("id"), pa.array(n.astype(np.int64))], names=["id", "n"])

    first = staged(points.blocks.select("rows").mapInArrow(inside, "id long, n long"))
    flat = points.blocks.select(F.inline("rows"))
    open_rows = metric.build(flat.join(first.where(F.col("n") < min_samples).select("id"), "id"), ["id", "m"], points.pivots)
    counted = staged(metric.near_counts(open_rows, points, eps, "m", min_samples).where(F.col("n") >= min_samples).select("id"))
    core = first.where(F.col("n") >= min_samples).select("id").unionByName(counted).withColumn("core", F.lit(True))

    def parts(batches):
        """Core rows that are linked inside their block get the smallest id among them, others null."""
        for batch in batches:
            for i in range(batch.num_rows):
                side = batch.column("rows")[i].values
                x, ids = metric.matrix(side), side.field("id").to_numpy()
                own = np.flatnonzero(side.field("core").to_numpy(zero_copy_only=False).astype(bool))
                label = density_parts(metric.squares(x[own], x[own]) <= limit)
                least = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(least, label, ids[own])
                part = np.full(len(ids), -1, np.int64)
                part[own] = least[label]
                named = pa.array(part, mask=~np.isin(np.arange(len(ids)), own))
                packed = pa.StructArray.from_arrays([side.field("v"), side.field("id"), named], ["v", "id", "part"])
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), packed)], names=["block", "rows"])

    marked = points.blocks.select("block", F.inline("rows")).join(core, "id", "left").groupBy("block").agg(F.collect_list(F.struct("v", "id", F.coalesce("core", F.lit(False)).alias("core"))).alias("rows"))
    labelled = staged(metric.packed(marked.mapInArrow(parts, "block long, rows array<struct<v: array<double>, id: long, part: long>>"), ["id", "part"]))

    def links(pairs):
        """Parts that touch, and parts that reach a row that is no core, once for each tile."""
        found = set()
        for a, b in pairs:
            sides = [(s.x, s.tag("id"), s.tags.field("part").fill_null(-1).to_numpy()) for s in (a, b)]
            if a.block != b.block:
                found |= {(p, q, False) for p, q in touching(sides[0], sides[1], limit)}
            for (x, ids, part), (y, _, reach) in ((sides[0], sides[1]), (sides[1], sides[0]))[: 1 + (a.block != b.block)]:
                edge, cores = np.flatnonzero(part < 0), np.flatnonzero(reach >= 0)
                if len(edge) and len(cores):
                    i, j = np.nonzero(metric.squares(x[edge], y[cores]) <= limit)
                    # All parts that reach a row count, as which of them is first is known in the end only.
                    found |= set(zip(ids[edge][i].tolist(), reach[cores][j].tolist(), [True] * len(i)))
        if found:
            source, target, border = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(target, pa.int64()), pa.array(border)], names=["source", "target", "border"])

    pairs = metric.candidates(points, points, F.lit(float(eps)), half=True)
    found = staged(metric.tiled(pairs, labelled, labelled, links, "source long, target long, border boolean"))
    own = labelled.select(F.inline("rows")).select("v", "id", "part")
    roots = staged(graphs.components(own.where("part IS NOT NULL").select(F.col("part").alias("node_id")).distinct(), found.where("NOT border")))
    numbers = numbered(roots.select("component").distinct(), [F.col("component")], "cluster").select("component", (F.col("cluster") - 1).cast("int").alias("cluster"))
    clusters = staged(roots.join(numbers, "component").select(F.col("node_id").alias("part"), "cluster"))
    borders = found.where("border").select(F.col("source").alias("id"), F.col("target").alias("part")).join(clusters, "part").groupBy("id").agg(F.min("cluster").alias("border"))
    labels = own.join(clusters, "part", "left").join(borders, "id", "left").select(F.col("v").alias("_v"), F.coalesce("cluster", "border").alias("cluster"))
    return rows.withColumn("_v", F.col("v").cast("array<double>")).join(labels, "_v", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def density_parts(near: np.ndarray) -> np.ndarray:
    """Connected parts of a symmetric matrix of links, numbered by their first rows."""
    label, count = np.full(len(near), -1), 0
    for i in range(len(near)):
        if label[i] < 0:
            front = np.array([i])
            while len(front):
                label[front] = count
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
            count += 1
    return label


def touching(a: tuple, b: tuple, limit: float, rows: int = 256) -> set[tuple[int, int]]:
    """Pairs of parts of two blocks (vectors, ids, parts; -1: none) with rows within the limit.

    Rows are compared a slice at a time, and only parts that are not linked yet, so two dense blocks of
    one part each are done at the first link.
    """
    from tessera.operators import metric

    (x, _, p), (y, _, q) = a, b
    found: set[tuple[int, int]] = set()
    cores, others = np.flatnonzero(p >= 0), np.flatnonzero(q >= 0)
    parts = np.unique(q[others])
    for part in np.unique(p[cores]).tolist():
        mine, open_parts = cores[p[cores] == part], set(parts.tolist())
        for at in range(0, len(mine), rows):
            left = others[np.isin(q[others], list(open_parts))] if len(open_parts) < len(parts) else others
            if not len(left):
                break
            hit = (metric.squares(x[mine[at : at + rows]], y[left]) <= limit).any(axis=0)
            new = set(np.unique(q[left[hit]]).tolist())
            found |= {(part, other) for other in new}
            open_parts -= new
    return found


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest silhouette, then Calinski-Harabasz, from a small table of (k, silhouette, calinski_harabasz)."""
    return scores.orderBy(F.desc("silhouette"), F.desc("calinski_harabasz"), "k").limit(1)


def summarise_clusters(df: DataFrame, cluster: str, outcome: str, low: float = 0.25, high: float = 0.6) -> DataFrame:
    """Size, rate and profile label (stable, mixed or elevated) of each cluster."""
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("row_count"), (F.sum(F.col(outcome).cast("long")) / F.count(F.lit(1))).alias("outcome_rate"))
    return out.withColumn("profile", F.when(F.col("outcome_rate") <= low, "stable").when(F.col("outcome_rate") >= high, "elevated").otherwise("mixed"))


def validation(df: DataFrame, features: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """Silhouette and smallest cluster share of k-means and bisecting k-means for each k."""
    rows = []
    for k in ks:
        for name, method in (("kmeans", kmeans), ("bisecting", bisecting)):
            found = method(df, features, k, seed).cache()
            sizes = [r["count"] for r in found.groupBy("cluster").count().collect()]  # k rows
            rows.append((name, k, float(silhouette(found, features, "cluster")) if len(sizes) > 1 else None, min(sizes) / sum(sizes)))
            found.unpersist()
    return df.sparkSession.createDataFrame(rows, "method string, k int, silhouette double, smallest_share double")


def stability(df: DataFrame, features: str, key: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """Adjusted Rand index of k-means for every pair of seeds."""
    runs = {s: kmeans(df, features, k, s).select(key, F.col("cluster").alias(f"c{s}")) for s in seeds}
    joined = None
    for run in runs.values():
        joined = run if joined is None else joined.join(run, key)
    out = None
    for i, a in enumerate(seeds):
        for b in seeds[i + 1 :]:
            part = adjusted_rand(joined, f"c{a}", f"c{b}").withColumns({"seed_a": F.lit(a), "seed_b": F.lit(b)})
            out = part if out is None else out.unionByName(part)
    return out


def block_sensitivity(df: DataFrame, blocks: dict[str, Sequence[str]], k: int = 2) -> DataFrame:
    """Silhouette of k-means on standardised blocks of columns."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = []
    for name, columns in blocks.items():
        wide = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip").transform(df.select(*columns))
        scaled = StandardScaler(inputCol="_raw", outputCol="_block", withMean=True).fit(wide).transform(wide)
        rows.append((name, len(columns), float(silhouette(kmeans(scaled, "_block", k), "_block", "cluster"))))
    return df.sparkSession.createDataFrame(rows, "block string, columns int, silhouette double")


def session_clusters(df: DataFrame, session: str, outcome: str, numeric: Sequence[str], categorical: Sequence[str], ks: Sequence[int] = range(2, 9), starts: int = 20) -> tuple[DataFrame, DataFrame]:
    """Clusters of whole sessions: the scores of each k, and session, cluster, outcome_rate with the best k's labels.

    A session is its mean numbers and most common categories (ties: the smallest), standardised and one-hot;
    clusters are numbered from 0 by ascending outcome rate.  Fewer than three sessions give empty tables.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tessera.operators import centres
    from tessera.operators.sessions import session_profile

    rate = F.avg(F.col(outcome).cast("double")).alias("outcome_rate")
    table = staged(session_profile(df.where(F.col(session).isNotNull()), session, numeric, categorical, [rate]))
    n = table.count()
    names = "k int, inertia double, iterations int, silhouette double, davies_bouldin double, calinski_harabasz double, smallest_share double"
    if n < 3:
        return df.sparkSession.createDataFrame([], names), table.select(session, F.lit(0).alias("cluster"), "outcome_rate").where("false")
    table = table.fillna(0.0, list(numeric)).fillna("", list(categorical))
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
    parts = ["_s"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=False)]
        parts.append(f"_h_{c}")
    ready = Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="_f")]).fit(table).transform(table)
    # Sums differ in their last bits with the order of rows; starts are drawn by a hash of the numbers, so those bits must not count.
    ready = staged(ready.select(session, "outcome_rate", F.transform(vector_to_array("_f"), lambda x: F.round(x, DIGITS)).alias("v")))
    runs = centres.k_sweep(ready, "v", [k for k in ks if k < n], starts)
    scores = staged(centres.scored(ready, "v", runs))
    best = best_k(scores).first()["k"]
    labelled = staged(centres.assigned(ready, "v", next(r.centres for r in runs if r.k == best)).select(session, "cluster", "outcome_rate"))  # a row is labelled once for the order and the result
    order = labelled.groupBy("cluster").agg(F.avg("outcome_rate").alias("r"))
    new = order.select("cluster", (F.row_number().over(Window.partitionBy().orderBy("r", "cluster")) - 1).alias("_new"))  # one row for each cluster
    return scores, labelled.join(F.broadcast(new), "cluster").select(session, F.col("_new").alias("cluster"), "outcome_rate")


def valid_partition(clusters: int, noise: float, smallest: float, silhouette_value: float | None) -> bool:
    """Whether a density clustering is worth reporting."""
    return clusters >= 2 and noise <= 0.6 and smallest >= 0.01 and silhouette_value is not None
