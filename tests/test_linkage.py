"""Ward's method against merging the cheapest pair of all, again and again."""

import numpy as np

from tessera.operators import linkage


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {m: c for c, g in enumerate(sorted(groups, key=min)) for m in g}


def test_ward_against_all_pairs(spark):
    x = np.random.default_rng(8).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    for k in (1, 2, 5, 20):
        assert {r.id: r.cluster for r in linkage.ward(df, "id", "v", k).collect()} == brute_ward(x, k)
    assert linkage.ward(df, "id", "v", 100).select("cluster").distinct().count() == 60
    assert linkage.ward(df, "id", "v", 3, bound=20).count() == 20
    assert linkage.ward(df.limit(0), "id", "v", 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, v array<double>")
    assert linkage.ward(same, "id", "v", 1).select("cluster").distinct().count() == 1


def test_every_row_joins_a_cluster(spark):
    x = np.random.default_rng(9).normal(size=(300, 2)) + 20 * (np.arange(300) % 3)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    got = {r.id: r.cluster for r in linkage.ward_all(df, "id", "v", 3, bound=40).collect()}
    assert got.pop(900) is None and len(got) == 300
    assert len({(i % 3, c) for i, c in got.items()}) == 3
    assert linkage.ward_all(df.where("v IS NULL"), "id", "v", 3).first().cluster is None
