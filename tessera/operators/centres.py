"""Partitions by centres for many numbers of clusters at once: k-means with many starts, diagonal Gaussian mixtures.

Equal rows are counted first, and every distinct one is seen with its copies.  One pass over them moves the
centres of every k and every start: a task holds all centres (their number follows from the parameters) and
passes on sums, which ``sums.summed`` adds up.  So a sweep over k = 2..8 with 20 starts takes as many passes as
the slowest start has iterations, not 140 times as many.  Starts are drawn from all rows, one more centre of every
run in a pass, and scores are those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.metric import distances, from_bytes, packed, squares
from tessera.operators.staging import staged
from tessera.operators.sums import matrix, summed

# Fixed values.
K_RANGE = range(2, 9)
STARTS = 20
RIDGE = 1e-6
#: Rows that are compared with all centres at a time; bounds a task's memory, and what is compared stays in its cache.
ROWS = 512
#: Rows of a block of the silhouette, shares that its blocks are dealt into, and most bytes of a share's numbers.
BLOCK, SHARES, SHARE = 1024, 24, 1 << 24


def _vectors(df: DataFrame, vector: str, copies: str | None = None) -> DataFrame:
    """Distinct vectors ``v`` with the number ``n`` of their rows."""
    each = F.lit(1) if copies is None else F.col(copies)
    held = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), each.cast("long").alias("n"))
    return staged(held.groupBy("v").agg(F.sum("n").alias("n")))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        yield matrix(part), part.column("n").to_numpy().astype(float)


@dataclass(frozen=True)
class Run:
    """One start of k-means."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float
    iterations: int


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and variance of each number over all rows; None without any."""
    sums = summed(rows, lambda batch: {0: batch.column("n").to_numpy().astype(float) @ np.column_stack([np.ones(batch.num_rows), matrix(batch)])})
    if not sums:
        return None
    mean = sums[0][1:] / sums[0][0]
    return mean, summed(rows, lambda batch: {0: batch.column("n").to_numpy().astype(float) @ (matrix(batch) - mean) ** 2})[0] / sums[0][0]


def spread_starts(rows: DataFrame, keys: Sequence[tuple[int, int]], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """For each (k, start) k rows of all, each drawn with a chance in proportion to its squared distance from those drawn before, and to its copies."""
    hashed, chosen = rows.select("v", "n", F.xxhash64("v").alias("h")), {key: [] for key in keys}
    for step in range(max((k for k, _ in keys), default=0)):
        for key, row in _drawn(hashed, {key: chosen[key] for key in keys if key[0] > step}, seed).items():
            chosen[key].append(row)
    return {key: np.array(c) for key, c in chosen.items()}


def _drawn(hashed: DataFrame, runs: dict[tuple[int, int], list[np.ndarray]], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """The next row of each run, all of which have as many; one pass.

    The least of exponential times, whose rates are the chances, belongs to a row with just its chance.  A time
    follows from the hashes of row and run, so it depends neither on batches nor on partitions.  Rows where a run has
    one already are taken by their copies, and only if there is no other.
    """
    keys = sorted(runs)
    size = len(runs[keys[0]])
    held = np.array([c for key in keys for c in runs[key]])
    salts = np.array([np.random.SeedSequence([seed, *key, size]).generate_state(1, np.uint64)[0] for key in keys])

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bool, float, list[float]]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x, n = matrix(part), part.column("n").to_numpy().astype(float)
                near = np.ones((len(x), len(keys)))
                if size:
                    near = squares(x, held).reshape(len(x), len(keys), size).min(axis=2)
                    near[near <= 1e-12 * (1 + (x**2).sum(axis=1, keepdims=True))] = 0
                z = (part.column("h").to_numpy().astype(np.uint64)[:, None] ^ salts[None]) + np.uint64(0x9E3779B97F4A7C15)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                times = -np.log((((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / n[:, None]
                times /= np.where(near > 0, near, 1)
                away = np.where(near > 0, times, np.inf)
                for run in range(len(keys)):
                    on = not (near[:, run] > 0).any()
                    row = int((times if on else away)[:, run].argmin())
                    found = on, float(times[row, run]), x[row].tolist()
                    best[run] = min(best.get(run, found), found)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *[pa.array([b[j] for b in best.values()], t) for j, t in enumerate((pa.bool_(), pa.float64(), pa.list_(pa.float64())))]], names=["run", "on", "time", "v"])

    first = hashed.mapInArrow(race, "run int, on boolean, time double, v array<double>").groupBy("run").agg(F.min(F.struct("on", "time", "v"))["v"].alias("v"))
    return {keys[r["run"]]: np.array(r["v"]) for r in first.collect()}  # a row for each run


def k_sweep(df: DataFrame, vector: str, ks: Sequence[int] = K_RANGE, starts: int = STARTS, seed: int = 42, iterations: int = 100, tolerance: float = 1e-4, copies: str | None = None) -> list[Run]:
    """The best start (least inertia, then the first) for each k; a row stands for ``copies`` rows.

    A start is done when its centres move by no more than ``tolerance`` times the mean variance of a number,
    in squares and all together; starts that are done leave the batch.  A centre without rows stays.
    """
    rows = _vectors(df, vector, copies)
    moments = _moments(rows)
    if moments is None:
        return []
    open_runs = spread_starts(rows, [(k, s) for k in ks for s in range(starts)], seed)
    limit = tolerance * float(moments[1].mean())
    done: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for turn in range(1, iterations + 1):
        for key, (_, table) in _passed(rows, open_runs).items():
            old = open_runs[key]
            new = np.where(table[:, :1] > 0, table[:, 1:] / np.maximum(table[:, :1], 1), old)
            open_runs[key] = new
            if ((new - old) ** 2).sum() <= limit or turn == iterations:
                done[key] = open_runs.pop(key), turn
        if not open_runs:
            break
    last = _passed(rows, {key: c for key, (c, _) in done.items()})
    runs = [Run(*key, done[key][0], float(inertia), done[key][1]) for key, (inertia, _) in last.items()]
    return [min((r for r in runs if r.k == k), key=lambda r: (round(r.inertia, 6), r.start)) for k in ks]


def _passed(rows: DataFrame, runs: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """Inertia, and number and sum of the rows of each centre, for each run; one pass."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for key in sorted(runs):
        groups.setdefault(key[0], []).append(key)
    centres = {k: np.stack([runs[key] for key in keys], axis=1) for k, keys in groups.items()}  # centre, run, number
    out = {}
    for k, sums in summed(rows, lambda batch: _lloyd(batch, centres)).items():
        keys = groups[k]
        tables = sums[len(keys) :].reshape(k, len(keys), -1)
        out |= {key: (sums[i], tables[:, i]) for i, key in enumerate(keys)}
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, row): the first nearest centre of each row, and the square of its distance less that of the row's length.

    ``x`` has a leading column of ones.  Rows run along the last axis, so centres are compared in long strides.
    """
    k, runs, _ = centres.shape
    apart = (np.concatenate([(centres**2).sum(axis=2, keepdims=True), -2 * centres], axis=2).reshape(k * runs, -1) @ x.T).reshape(k, runs, -1)
    best, own = apart[0].copy(), np.zeros(apart.shape[1:], np.int16)
    for j in range(1, k):
        np.copyto(own, j, where=apart[j] < best)
        np.minimum(best, apart[j], out=best)
    return own, best


def _lloyd(batch: pa.RecordBatch, groups: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each k: the inertia of its runs, then number and sum of the rows of each centre of each run."""
    out: dict[int, np.ndarray] = {}
    for x, n in _slices(batch):
        ones, lengths = np.column_stack([np.ones(len(x)), x]), (x**2).sum(axis=1)
        weighed = ones * n[:, None]
        for k, centres in groups.items():
            own, best = _nearest(ones, centres)
            inertia = (best + lengths).clip(0) @ n
            mine = np.empty((k, *own.shape))
            for j in range(k):
                mine[j] = own == j
            sums = np.append(inertia, (mine.reshape(-1, len(x)) @ weighed).ravel())
            out[k] = out[k] + sums if k in out else sums
    return out


def assigned(df: DataFrame, vector: str, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Adds the nearest centre's number; null for a null vector."""

    @F.pandas_udf("int")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series([None] * len(part), dtype="Int32")
            known = part.notna().to_numpy()
            if known.any():
                out[known] = squares(np.stack(part[known].to_numpy()).astype(float), centres).argmin(axis=1).astype(np.int32)
            yield out

    return df.withColumn(name, nearest(F.col(vector).cast("array<double>")))


def _first(df: DataFrame, rows: int, copies: str | None) -> DataFrame:
    """At most ``rows`` rows in hash order, each of which stands for ``copies`` rows."""
    order = [F.xxhash64("v"), F.col("v")]
    held = df.orderBy(*order).limit(rows)
    if copies is None:
        return held
    before = F.coalesce(F.sum(copies).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``rows`` rows
    taken = held.withColumn("_before", before).where(F.col("_before") < rows)
    return taken.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col(copies), rows - F.col("_before"))))).drop("_before", "_each")


def silhouette(df: DataFrame, vector: str, clusters: Sequence[str], rows: int | None = None, copies: str | None = None) -> dict[str, float | None]:
    """Mean Euclidean silhouette of several labellings, on all rows or, where ``rows`` is given, on at most so many in hash order.

    Rows are dealt into blocks and blocks into at most ``SHARES`` shares (more only where a share would be larger
    than ``SHARE`` bytes).  A task holds two shares and gives, for each of their rows, the sums of its distances to
    each cluster: as exact as it is quadratic in time, but a row travels only once for each share.  Labels
    below 0 and nulls are left out; a cluster of one row counts 0; fewer than two clusters give None.  With
    ``copies`` a row stands for that many and is compared once.
    """
    names = [f"c{i}" for i in range(len(clusters))]
    held = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(n) for c, n in zip(clusters, names)], *([F.col(copies).cast("long").alias("n")] if copies else []))
    held = _first(held, rows, "n" if copies else None) if rows else held
    held = staged(held.select("v", *names, (F.col("n") if copies and not rows else F.lit(1).cast("long")).alias("n")))
    counted = held.select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("c")) for i, n in enumerate(names)])).alias("x")).groupBy("x.i", "x.c").agg(F.sum("n").alias("count")).where("c >= 0").toPandas()  # a row for each cluster
    sizes = {i: part.sort_values("c").set_index("c")["count"] for i, part in counted.groupby("i") if len(part) > 1}
    if not sizes:
        return dict.fromkeys(clusters)
    size = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    count = -(-size["n"] // BLOCK)
    shares = max(min(SHARES, count), -(-size["n"] * max(size["d"], 1) * 8 // SHARE))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).alias("block")
    blocks = staged(packed(held.groupBy(block).agg(F.collect_list(F.struct("v", *names, "n")).alias("rows")), [*names, "n"]).select("block", "x", "tags"))
    share = F.pmod(F.col("block"), F.lit(shares)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("other")
    dealt = blocks.withColumn("share", share).select("*", other).withColumns({"low": F.least("share", "other"), "high": F.greatest("share", "other")}).drop("other")

    def total(table: pa.Table) -> pa.Table:
        """Sums of distances of the rows of each block of two shares to the clusters of the other's blocks."""
        same = table.column("low")[0] == table.column("high")[0]
        held = []
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                tags = batch.column("tags")[i].values
                hot = np.concatenate([tags.field(f"c{c}").to_numpy()[:, None] == n.index.to_numpy()[None, :] for c, n in sizes.items()], axis=1) * tags.field("n").to_numpy()[:, None].astype(float)
                held.append((batch.column("block")[i].as_py(), batch.column("share")[i] == batch.column("low")[i], batch.column("x")[i].as_buffer(), hot))
        held.sort(key=lambda h: h[0])
        sums = {h[0]: np.zeros(h[3].shape) for h in held}
        for at, (a, left, x_bytes, hot) in enumerate(held):
            if not (left or same):
                continue
            x = from_bytes(x_bytes, len(hot))
            for b, right_left, y_bytes, other_hot in held[at:] if same else [h for h in held if not h[1]]:
                y = from_bytes(y_bytes, len(other_hot))
                d = distances(x, y)
                i, j = np.nonzero(d < 1e-4 * (1 + np.abs(x).max(initial=0)))
                d[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))  # small ones suffer from rounding
                sums[a] += d @ other_hot
                if a != b:
                    sums[b] += d.T @ hot
        return pa.table({"block": pa.array(list(sums), pa.int64()), "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(s.as_py(), float) for s in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([whole.tobytes()], pa.binary())})

    def score(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for i in range(batch.num_rows):
            side = batch.column("tags")[i].values
            table = np.frombuffer(batch.column("sums")[i].as_py(), float).reshape(len(side), -1)
            begin = 0
            for c, n in sizes.items():
                sums, begin = table[:, begin : begin + len(n)], begin + len(n)
                own = side.field(f"c{c}").to_numpy()
                sums, each, mine = sums[own >= 0], side.field("n").to_numpy()[own >= 0], np.searchsorted(n.index.to_numpy(), own[own >= 0])
                size, r = n.to_numpy(), np.arange((own >= 0).sum())
                a = sums[r, mine] / np.maximum(size[mine] - 1, 1)
                means = sums / size
                means[r, mine] = np.inf
                b = means.min(axis=1)
                s = np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
                out[c] = out.get(c, 0) + np.array([s @ each, each.sum()])
        return out

    added = dealt.groupBy("low", "high").applyInArrow(total, "block long, sums binary").groupBy("block").applyInArrow(add, "block long, sums binary")
    found = summed(blocks.select("block", "tags").join(added, "block").select("tags", "sums"), score)
    return {c: float(found[i][0] / found[i][1]) if i in found and found[i][1] else None for i, c in enumerate(clusters)}


def sweep_table(df: DataFrame, vector: str, ks: Sequence[int] = K_RANGE, starts: int = STARTS, seed: int = 42, rows: int | None = None) -> DataFrame:
    """k, inertia, iterations, silhouette, davies_bouldin, calinski_harabasz and the smallest cluster's share, for the best start of each k."""
    return scored(df, vector, k_sweep(df, vector, ks, starts, seed), rows)


def scored(df: DataFrame, vector: str, runs: Sequence[Run], rows: int | None = None) -> DataFrame:
    """The scores of ``sweep_table`` for runs that have been made."""
    names = "k int, inertia double, iterations int, silhouette double, davies_bouldin double, calinski_harabasz double, smallest_share double"
    if not runs:
        return df.sparkSession.createDataFrame([], names)
    columns = [f"k{r.k}" for r in runs]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.zeros(0, np.int32)] * len(runs)
            for x, _ in _slices(batch):
                ones = np.column_stack([np.ones(len(x)), x])
                own = [np.append(o, _nearest(ones, r.centres[:, None])[0][0].astype(np.int32)) for o, r in zip(own, runs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own)], names=[*batch.schema.names, *columns])

    counted = _vectors(df, vector)
    labelled = staged(counted.mapInArrow(label, StructType([*counted.schema.fields, *[StructField(c, IntegerType()) for c in columns]])))
    scores = silhouette(labelled, "v", columns, rows, "n")

    def members(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        """Number and sum of each cluster's rows."""
        x, n = matrix(batch), batch.column("n").to_numpy().astype(float)
        weighed = np.column_stack([n, x * n[:, None]])
        return {i: ((batch.column(c).to_numpy()[:, None] == np.arange(runs[i].k)).T.astype(float) @ weighed).ravel() for i, c in enumerate(columns)}

    tables = {i: sums.reshape(runs[i].k, -1) for i, sums in summed(labelled, members).items()}
    means = {i: t[:, 1:] / np.maximum(t[:, :1], 1) for i, t in tables.items()}

    def spreads(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        """Sums of the distances of each cluster's rows to their mean, then of their squares."""
        x, n = matrix(batch), batch.column("n").to_numpy().astype(float)
        out = {}
        for i, c in enumerate(columns):
            own = batch.column(c).to_numpy()
            square = ((x - means[i][own]) ** 2).sum(axis=1)
            out[i] = np.concatenate([np.bincount(own, w * n, runs[i].k) for w in (np.sqrt(square), square)])
        return out

    apart = summed(labelled, spreads)
    out = [(r.k, r.inertia, r.iterations, scores[c], *_validity(tables[i], means[i], *apart[i].reshape(2, -1))) for i, (c, r) in enumerate(zip(columns, runs))]
    return df.sparkSession.createDataFrame(out, names)


def _validity(table: np.ndarray, means: np.ndarray, spread: np.ndarray, within: np.ndarray) -> tuple[float | None, float | None, float]:
    """Davies-Bouldin and Calinski-Harabasz as in ``clustering``, and the smallest cluster's share; clusters without rows do not count."""
    held = table[:, 0] > 0
    size, means, spread, within = table[held, 0], means[held], spread[held] / table[held, 0], float(within[held].sum())
    k, n = len(size), size.sum()
    between = float(size @ ((means - size @ means / n) ** 2).sum(axis=1))
    ch = round(float(between / (k - 1) / (within / (n - k))), 6) if k > 1 and within > 0 and n > k else None
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    db = round(float(((spread[:, None] + spread[None]) / apart).max(axis=1).mean()), 6) if k > 1 else None
    return db, ch, float(size.min() / n)


@dataclass(frozen=True)
class Mixture:
    """A mixture of Gaussians with diagonal covariances; ``path`` has the log-likelihood after each step."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    rows: float
    path: tuple[float, ...]

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + 2 * k * d

    @property
    def bic(self) -> float:
        return self.parameters * float(np.log(self.rows)) - 2 * self.path[-1]

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.path[-1]


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log of weight times density, for each row and component."""
    inverse = 1 / variances
    square = (x**2) @ inverse.T - 2 * x @ (means * inverse).T + (means**2 * inverse).sum(axis=1)
    return np.log(np.maximum(weights, 1e-300)) - (square + np.log(variances).sum(axis=1) + x.shape[1] * np.log(2 * np.pi)) / 2


def mixtures(df: DataFrame, vector: str, ks: Sequence[int] = K_RANGE, starts: int = 1, seed: int = 42, iterations: int = 100, tolerance: float = 1e-3, ridge: float = RIDGE) -> list[Mixture]:
    """One mixture for each k by expectation and maximisation, all in one batch of passes.

    Each begins with the partition of its best k-means start.  It is done when the mean log-likelihood of a row
    grows by less than ``tolerance``.  Rows are centred by their mean, so that squares keep their digits.
    """
    rows = _vectors(df, vector)
    runs = k_sweep(rows, "v", ks, starts, seed, copies="n")
    if not runs:
        return []
    centre = _moments(rows)[0]
    d = len(centre)

    def steps(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        table = sums[1:].reshape(k, 1 + 2 * d)
        size = table[:, 0] + 10 * np.finfo(float).eps
        means = table[:, 1 : 1 + d] / size[:, None]
        variances = np.maximum(table[:, 1 + d :] / size[:, None] - means**2, 0) + ridge
        return size / size.sum(), means, variances, float(sums[0]), float(table[:, 0].sum())

    def totals(batch: pa.RecordBatch, weights_of) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for x, n in _slices(batch):
            x = x - centre
            both = np.column_stack([np.ones(len(x)), x, x**2]) * n[:, None]
            for at, given in weights_of(x):
                share, log = given
                sums = np.append(log @ n, (share.T @ both).ravel())
                out[at] = out[at] + sums if at in out else sums
        return out

    def first(x: np.ndarray):
        for at, run in enumerate(runs):
            yield at, (np.eye(run.k)[squares(x, run.centres - centre).argmin(axis=1)], np.zeros(len(x)))

    now = {at: steps(s, runs[at].k) for at, s in summed(rows, lambda batch: totals(batch, first)).items()}
    paths: dict[int, list[float]] = {at: [] for at in now}
    done: dict[int, Mixture] = {}
    for turn in range(iterations + 1):
        held = {at: p[:3] for at, p in now.items()}

        def expected(x: np.ndarray, held=held):
            for at, p in held.items():
                log = log_densities(x, *p)
                top = log.max(axis=1, keepdims=True)
                whole = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
                yield at, (np.exp(log - whole), whole[:, 0])

        for at, s in summed(rows, lambda batch, expected=expected: totals(batch, expected)).items():
            new = steps(s, runs[at].k)
            paths[at].append(new[3])
            settled = len(paths[at]) > 1 and (paths[at][-1] - paths[at][-2]) / new[4] < tolerance
            if settled or turn == iterations:
                weights, means, variances = held[at]
                done[at] = Mixture(weights, means + centre, variances, new[4], tuple(paths[at]))
                del now[at]
            else:
                now[at] = new
        if not now:
            break
    return [done[at] for at in sorted(done)]


def mixture_table(df: DataFrame, vector: str, ks: Sequence[int] = K_RANGE, starts: int = 1, seed: int = 42) -> DataFrame:
    """k, log_likelihood, bic, aic, steps, and whether its BIC is the lowest (ties: fewer components)."""
    found = mixtures(df, vector, ks, starts, seed)
    best = min(range(len(found)), key=lambda i: (found[i].bic, i), default=None)
    rows = [(len(m.weights), m.path[-1], m.bic, m.aic, len(m.path), i == best) for i, m in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double, steps int, chosen boolean")
