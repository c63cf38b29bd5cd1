"""OPTICS against plain quadratic versions: the order one step at a time, the clusters from all pairs of steep areas."""

import math

import numpy as np
import pytest

from tessera.operators import optics


def plain_order(x, least):
    d = [[math.dist(a, b) for b in x] for a in x]
    core = [sorted(row)[least - 1] if len(x) >= least else math.inf for row in d]
    reach, done, order = [math.inf] * len(x), set(), []
    while len(order) < len(x):
        at = min((i for i in range(len(x)) if i not in done), key=lambda i: (reach[i], i))
        done.add(at)
        order.append(at)
        if core[at] < math.inf:
            for j in range(len(x)):
                if j not in done:
                    reach[j] = min(reach[j], max(core[at], d[at][j]))
    return order, core, reach


@pytest.mark.parametrize("least", [1, 3, 8])
def test_order_against_plain_version(least):
    x = np.random.default_rng(least).integers(0, 6, size=(70, 2)).astype(float)  # small integers: exact distances, many ties
    order, core, reach, _ = optics.reachability_order(x, least)
    want = plain_order(x.tolist(), least)
    assert order.tolist() == want[0]
    assert np.allclose(core, want[1]) and np.allclose(reach[1:], want[2][1:])


def plain_clusters(plot, least, smallest, xi):
    """Every fall with every later rise, as the definition says; no correction of ends."""
    plot, out = [*plot, math.inf], set()
    areas = optics.steep_areas(np.array(plot), least, xi)
    for a, b, falls in areas:
        for c, e, falls_too in areas:
            if not falls or falls_too or c <= b:
                continue
            low = max(plot[b + 1 : c + 1], default=0)
            if low == math.inf or low > (1 - xi) * plot[a] or low > (1 - xi) * plot[e + 1]:
                continue
            start, end = a, e
            if plot[a] * (1 - xi) >= plot[e + 1]:
                start = max([a] + [i for i in range(a + 1, b + 1) if plot[i] > plot[e + 1]])
            elif plot[e + 1] * (1 - xi) >= plot[a]:
                end = min([e] + [i for i in range(c, e) if plot[i] > plot[a]])
            if end - start + 1 >= smallest:
                out.add((start, end))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_clusters_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    plot = np.concatenate([[np.inf], np.exp(np.cumsum(rng.normal(scale=0.3, size=60)))])
    inside = np.arange(-1, 60)  # every row was reached from the one before, so no end is drawn in
    got = optics.xi_clusters(plot, inside, 3, 4, 0.05)
    assert len(got) == len(set(got)) and set(got) == plain_clusters(plot, 3, 4, 0.05)


def test_steep_areas():
    inf = math.inf
    assert optics.steep_areas(np.array([inf, 1.0, 1.0, 4.0, 4.0, inf]), 2, 0.05) == [(0, 0, True), (2, 4, False)]
    assert optics.steep_areas(np.array([0.0, 0.0, 0.0, inf]), 2, 0.05) == [(2, 2, False)]


def test_whole_table(spark):
    rng = np.random.default_rng(5)
    of = np.arange(400) % 4
    x = np.where(of[:, None] < 3, rng.normal(scale=0.3, size=(400, 2)) + 10 * of[:, None], rng.uniform(-40, 60, size=(400, 2)))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, cluster string").repartition(3)
    got = optics.optics(df, "id", "v", [5], rows=200).toPandas()
    assert len(got) == 401 and got["sampled"].sum() == 200
    none = got[got["id"] == 900].iloc[0]
    assert none["cluster"] == -1 and np.isnan(none["place"])
    inner = got[(got["id"] < 400) & (got["id"] % 4 < 3) & (got["cluster"] >= 0)]
    assert len(inner) > 240 and inner.groupby(inner["id"] % 4)["cluster"].nunique().eq(1).all() and inner["cluster"].nunique() == 3
    again = optics.optics(df.repartition(7), "id", "v", [5], rows=200).toPandas()
    assert got.sort_values("id")["cluster"].tolist() == again.sort_values("id")["cluster"].tolist()
    assert sorted(got["place"][got["sampled"]]) == list(range(200))
    score = optics.optics_sweep(df, "v", [25], rows=400).first()
    assert score.clusters >= 3 and score.valid and score.silhouette > 0.8


def test_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0]) for i in range(30)], "id long, v array<double>")
    few = optics.optics(df.limit(5), "id", "v", [10]).collect()
    assert len(few) == 5 and all(r.cluster == -1 and r.core_distance is None for r in few)
    same = optics.optics(df, "id", "v", [10]).collect()
    assert len(same) == 30 and {r.core_distance for r in same} == {0.0} and len({r.cluster for r in same}) == 1
    assert optics.optics(df.limit(0), "id", "v", [10]).count() == 0 and optics.optics_sweep(df.limit(0), "v").count() == 0
