"""Queries that answer for whole tables: small fixtures against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import clustering, metric, models
from tessera.plans import catalog


def brute_components(nodes, edges):
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(nodes):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = n
                stack.extend(near[x])
    return root


def test_connected_components_of_all_events(spark, tmp_path):
    r = random.Random(4)
    # Few links each, so that there are chains and several components; some events lack the user or k.
    rows = [(i, r.randrange(40), r.randrange(60)) for i in range(55)] + [(90, None, 77), (91, 78, None), (92, 500, 501), (93, None, None)]
    rows += [(100 + i, 1000 + i // 2, 1000 + (i + 1) // 2) for i in range(30)]
    events = [(i, u, float(i), "view", "{}" if k is None else f'{{"k": {k}}}') for i, u, k in rows]
    spark.createDataFrame(events, "event_id long, user_id long, value double, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    nodes = {f"u{u}" for _, u, _ in rows if u is not None} | {f"k{k}" for _, _, k in rows if k is not None}
    want = brute_components(nodes, {(f"u{u}", f"k{k}") for _, u, k in rows if u is not None and k is not None})
    got = [tuple(x) for x in catalog.queries()["connected_components"](spark, str(tmp_path)).collect()]
    assert len(got) == len(nodes) and dict(got) == want
    assert len(set(want.values())) > 5


def brute_dbscan(rows, eps, least):
    """Sequential DBSCAN in the order of keys."""
    rows = sorted((k, v) for k, v in rows if v is not None)
    x = np.array([v for _, v in rows])
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core, label, c = near.sum(axis=1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            while stack:
                fresh = np.flatnonzero(near[stack.pop()] & (label < 0))
                label[fresh] = c
                stack.extend(fresh[core[fresh]].tolist())
            c += 1
    return {k: int(n) for (k, _), n in zip(rows, label)}


def test_dbscan_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "ROWS", 40)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(260, 2)) * 3, np.repeat([[50.0, 50.0]], 9, axis=0)]).tolist()
    rows = [(int(k), v) for k, v in zip(rng.permutation(len(x)), x)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = brute_dbscan(rows, 0.55, 4) | {900: -1}
    got = [tuple(r) for r in clustering.dbscan(df, "id", "v", 0.55, 4).collect()]
    assert len(got) == len(rows) and dict(got) == want
    assert len(set(want.values())) > 4 and -1 in [want[k] for k, v in rows if v]


def test_clustered_rows_meet_few_blocks(spark):
    """Twice as many groups apart from each other make twice as many pairs of blocks, and all neighbours are found."""
    rng = np.random.default_rng(7)
    made = {}
    for groups in (6, 12):
        x = np.concatenate([rng.normal(size=(60, 3)) + rng.uniform(-1000, 1000, size=3) for _ in range(groups)])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("m", F.lit(1))
        index = metric.build(df, ["id", "m"], rows=30)
        got = {r.id: r.n for r in metric.near_counts(index, index, 1.0, "m").collect()}
        want = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1).sum(axis=1)
        assert [got[i] for i in range(len(x))] == want.tolist()
        assert index.blocks.agg(F.max(F.size("rows"))).first()[0] <= 30
        made[groups] = metric.candidates(index, index, F.lit(1.0)).count()
        assert made[groups] < 0.4 * index.blocks.count() ** 2
    assert made[12] < 3 * made[6]


def test_dbscan_query_labels_every_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(2500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.queries()["dbscan"](spark, str(tmp_path)).count() == 2500


def brute_neighbours(train, test, k):
    out = {}
    for key, q in test:
        near = sorted((float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), y) for v, y in train if v is not None and y is not None)[:k]
        w = [1 / max(d, 1e-9) for d, _ in near]
        out[key] = sum(a * y for a, (_, y) in zip(w, near)) / sum(w)
    return out


def test_nearest_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "ROWS", 30)
    rng = np.random.default_rng(5)
    train = [(v, float(i % 2)) for i, v in enumerate(rng.normal(size=(300, 4)).tolist())]
    train += [(train[0][0], float(i % 3 == 0)) for i in range(12)] + [(None, 1.0), (train[1][0], None)]
    test = [(i, v) for i, v in enumerate(rng.normal(size=(80, 4)).tolist())] + [(500, train[0][0]), (501, train[0][0]), (502, train[5][0])]
    a = spark.createDataFrame(train, "v array<double>, y double")
    b = spark.createDataFrame(test + [(900, None)], "id long, v array<double>")
    got = {r.id: r.score for r in models.nearest_neighbours(a, b, "id", "v", "y").collect()}
    want = brute_neighbours(train, test, 7)
    assert got.pop(900) is None and got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert {r.score for r in models.nearest_neighbours(a.limit(0), b, "id", "v", "y").collect()} == {None}


def test_nearest_neighbours_query_beyond_15000_training_rows(spark, tmp_path):
    rows = spark.range(19_000).select(F.col("id").alias("vec_id"), F.array(*[(F.xxhash64("id", F.lit(i)) % 1000).cast("float") for i in range(3)]).alias("embedding"), (F.col("id") % 4).cast("int").alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.queries()["nearest_neighbours"](spark, str(tmp_path)).where("score BETWEEN 0 AND 1").count() == 3800


def test_a_block_travels_once_for_each_tile(spark, monkeypatch):
    """All pairs of blocks are seen once, in tiles of bounded groups, those of a left block nearest first."""
    monkeypatch.setattr(metric, "TILE", 3)
    monkeypatch.setattr(metric, "WIDE", 5)
    monkeypatch.setattr(metric, "GROUPS", 6)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))], "id long, v array<double>")
    index = metric.build(df, ["id"], rows=30)
    pairs = metric.candidates(index, index, F.lit(9.0))

    def run(sides):
        seen = [(a.block, b.block, a.apart) for a, b in sides]
        yield pa.RecordBatch.from_arrays([pa.array([[f"{a} {b}" for a, b, _ in seen]]), pa.array([len({a for a, _, _ in seen})]), pa.array([len({b for _, b, _ in seen})]), pa.array([seen == sorted(seen, key=lambda s: (s[0], s[2]))])], names=["seen", "a", "b", "nearest"])

    tiles = metric.tiled(pairs, index.blocks, index.blocks, run, "seen array<string>, a long, b long, nearest boolean").collect()
    want = [f"{r.block_a} {r.block_b}" for r in pairs.collect()]
    assert sorted(s for t in tiles for s in t.seen) == sorted(want) and len(want) > 100
    assert max(t.a for t in tiles) <= 3 and max(t.b for t in tiles) <= 5 and all(t.nearest for t in tiles)
    assert sum(t.a + t.b for t in tiles) < len(want)
