"""Batched k-means, diagonal mixtures and the Euclidean silhouette against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import centres, clustering

RNG = np.random.default_rng(11)
GROUPS = np.array([[0.0, 0, 0], [9, 0, 1], [0, 9, -1]])
X = np.concatenate([g + RNG.normal(size=(n, 3)) for g, n in zip(GROUPS, (120, 80, 60))])


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, v) for i, v in enumerate(X.tolist())] + [(900, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def plain_inertia(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_sweep_moves_all_starts_together(df, monkeypatch):
    passes = []
    real = centres.summed
    monkeypatch.setattr(centres, "summed", lambda *a: passes.append(1) or real(*a))
    runs = centres.k_sweep(df, "v", [2, 3, 4], starts=6)
    assert len(passes) == max(r.iterations for r in runs) + 1 or len(passes) <= 101
    assert len(passes) < 3 * 6 * 2
    for r in runs:
        assert abs(r.inertia - plain_inertia(X, r.centres)) < 1e-6 * r.inertia
        own = ((X[:, None] - r.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert all(((X[own == c].mean(axis=0) - r.centres[c]) ** 2).sum() < 0.01 for c in range(r.k))  # Lloyd's fixed point
    three = next(r for r in runs if r.k == 3)
    assert abs(three.inertia - sum(((g - g.mean(axis=0)) ** 2).sum() for g in np.split(X, [120, 200]))) < 1e-6 * three.inertia
    assert runs[0].inertia > runs[1].inertia > runs[2].inertia


def test_tables_choose_three(df):
    table = centres.sweep_table(df, "v", [2, 3, 4], starts=4)
    assert clustering.best_k(table).first()["k"] == 3
    assert [r.k for r in centres.mixture_table(df, "v", [2, 3, 4]).where("chosen").collect()] == [3]
    assert centres.sweep_table(df.where("v IS NULL"), "v").count() == centres.mixture_table(df.where("v IS NULL"), "v").count() == 0


def test_mixture_against_plain_steps(df):
    X = globals()["X"] - 0.75 * np.repeat(GROUPS, (120, 80, 60), axis=0)  # groups that overlap
    df = df.sparkSession.createDataFrame([(v,) for v in X.tolist()], "v array<double>").repartition(2)
    m = centres.mixtures(df, "v", [3], starts=4, tolerance=1e-9)[0]
    assert all(b >= a - 1e-6 for a, b in zip(m.path, m.path[1:])) and len(m.path) > 5
    log = np.log(m.weights) - ((X[:, None] - m.means) ** 2 / m.variances + np.log(2 * np.pi * m.variances)).sum(axis=2) / 2
    whole = np.logaddexp.reduce(log, axis=1)
    assert abs(whole.sum() - m.path[-1]) < 1e-6 * abs(m.path[-1])
    share = np.exp(log - whole[:, None])
    assert np.allclose(share.mean(axis=0), m.weights, atol=1e-3)  # a fixed point of both steps
    means = share.T @ X / share.sum(axis=0)[:, None]
    assert np.allclose(means, m.means, atol=1e-2)
    assert abs(m.bic - ((2 + 18) * np.log(len(X)) - 2 * whole.sum())) < 1e-3 and m.rows == len(X)


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouette(df, monkeypatch):
    monkeypatch.setattr(centres, "BLOCK", 50)
    two = np.arange(len(X)) % 2
    odd = np.where(np.arange(len(X)) < 3, -1, np.arange(len(X)) % 4)
    odd[5] = 9
    label = {i: (int(a), int(b)) for i, (a, b) in enumerate(zip(two, odd))}
    spark = df.sparkSession
    rows = spark.createDataFrame([(i, *ab, 0) for i, ab in label.items()], "id long, two int, odd int, same int")
    got = centres.silhouette(df.join(rows, "id", "left"), "v", ["two", "odd", "same"])
    small = centres.silhouette(df.join(rows, "id", "left").repartition(5), "v", ["two"], rows=None)
    assert abs(small["two"] - plain_silhouette(X, two)) < 1e-6
    assert abs(got["two"] - plain_silhouette(X, two)) < 1e-6
    assert abs(got["odd"] - plain_silhouette(X[odd >= 0], odd[odd >= 0])) < 1e-6
    assert got["same"] is None
    assert centres.silhouette(df.where("v IS NULL").withColumn("c", F.lit(1)), "v", ["c"]) == {"c": None}


def test_equal_rows_are_seen_once(df, monkeypatch):
    copies = df.sparkSession.createDataFrame([(v,) for i, v in enumerate(X.tolist()) for _ in range(1 + i % 4)], "v array<double>").repartition(3)
    many, n = np.repeat(X, 1 + np.arange(len(X)) % 4, axis=0), []
    real = centres.summed
    monkeypatch.setattr(centres, "summed", lambda rows, *a: n.append(rows.count()) or real(rows, *a))
    runs = centres.k_sweep(copies, "v", [2, 3], starts=3)
    assert set(n) == {len(X)}
    for r in runs:
        assert abs(plain_inertia(many, r.centres) - r.inertia) < 1e-6 * r.inertia
    monkeypatch.setattr(centres, "summed", real)
    for row in centres.scored(copies, "v", runs).collect():
        run = next(r for r in runs if r.k == row.k)
        own = ((many[:, None] - run.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        labelled = df.sparkSession.createDataFrame([(v, int(c)) for v, c in zip(many.tolist(), own)], "v array<double>, c int")
        assert abs(row.davies_bouldin - clustering.davies_bouldin(labelled, "c", "v").first()[0]) < 2e-6
        assert abs(row.calinski_harabasz - clustering.calinski_harabasz(labelled, "c", "v").first()[1]) < 2e-6 * row.calinski_harabasz
        assert abs(row.smallest_share - np.bincount(own).min() / len(many)) < 1e-12
        assert abs(row.silhouette - plain_silhouette(many, own)) < 1e-6
    from tessera.operators.density import sampled

    plain = sampled(copies, "v", 100)
    assert np.array_equal(plain, sampled(centres._vectors(copies, "v"), "v", 100, "n"))
    cut = centres._vectors(copies, "v").withColumn("c", (F.col("v")[0] > 4).cast("int"))
    assert centres.silhouette(cut, "v", ["c"], 100, "n")["c"] == pytest.approx(plain_silhouette(plain, (plain[:, 0] > 4).astype(int)), abs=1e-6)


def test_a_row_of_the_silhouette_travels_once_for_each_share(df, monkeypatch):
    monkeypatch.setattr(centres, "BLOCK", 10)
    monkeypatch.setattr(centres, "SHARES", 4)
    counts = []
    real = centres.summed
    monkeypatch.setattr(centres, "summed", lambda rows, *a: counts.append(rows._jdf.queryExecution().toString()) or real(rows, *a))
    two = np.arange(len(X)) % 2
    rows = df.sparkSession.createDataFrame([(v, int(c)) for v, c in zip(X.tolist(), two)], "v array<double>, two int")
    assert abs(centres.silhouette(rows, "v", ["two"], rows=None)["two"] - plain_silhouette(X, two)) < 1e-6
    assert "block_b" not in counts[0] and "other" in counts[0]


def test_starts_and_scores_take_all_rows(df):
    """Beyond 4,000 and 8,000 rows, the samples that starts and silhouettes came from."""
    x = np.random.default_rng(4).normal(size=(8600, 2)).round(3)
    far = np.array([[400.0, 400.0]])
    many = df.sparkSession.createDataFrame([(v,) for v in np.concatenate([x, far]).tolist()], "v array<double>").repartition(3)
    runs = centres.k_sweep(many, "v", [2], starts=2)
    assert (np.abs(runs[0].centres - far[0]).max(axis=1) < 1e-9).any()  # whatever its hash, the far row is drawn
    halves = many.withColumn("c", (F.col("v")[0] > 0).cast("int"))
    whole = np.concatenate([x, far])
    got = centres.silhouette(halves, "v", ["c"])["c"]
    assert abs(got - plain_in_slices(whole, (whole[:, 0] > 0).astype(int))) < 1e-6
    counted = halves.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))
    assert abs(centres.silhouette(counted, "v", ["c"], copies="n")["c"] - got) < 1e-9


def plain_in_slices(x, label):
    out = []
    for i in range(0, len(x), 500):
        d = np.sqrt(((x[i : i + 500, None] - x[None]) ** 2).sum(axis=2))
        sums, size = np.stack([d[:, label == c].sum(axis=1) for c in (0, 1)], axis=1), np.bincount(label)
        own, r = label[i : i + 500], np.arange(len(d))
        a, b = sums[r, own] / (size[own] - 1), sums[r, 1 - own] / size[1 - own]
        out.append((b - a) / np.maximum(a, b))
    return float(np.concatenate(out).mean())


def test_starts_do_not_depend_on_partitions(df):
    few = [centres.spread_starts(centres._vectors(df.repartition(n), "v"), [(2, 0), (3, 0), (3, 1)], 7) for n in (1, 5)]
    assert all(np.array_equal(few[0][key], few[1][key]) and len(few[0][key]) == key[0] for key in few[0])
    same = centres._vectors(df.sparkSession.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>"), "v")
    assert centres.spread_starts(same, [(3, 0)], 7)[3, 0].tolist() == [[1.0, 2.0]] * 3
