"""Rank selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles, running

POINTS = {"q0": 0.0, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}


@pytest.mark.parametrize("few", [0, 50_000])
def test_quantiles_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(running, "FEW", few)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=300).round(1), "b": rng.integers(0, 5, 101).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), None: np.array([-1.0, 4.0, 9.0]), "empty": np.array([])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("empty", None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.summary(df, ["g"], "v", POINTS).collect()}
    assert got.keys() == {g for g, x in groups.items() if len(x)}
    for g, r in got.items():
        x = groups[g]
        assert (r.n, r.min, r.max) == (len(x), x.min(), x.max()) and abs(r["mean"] - x.mean()) < 1e-9
        assert r["std"] is None if len(x) == 1 else abs(r["std"] - x.std(ddof=1)) < 1e-9
        for name, q in POINTS.items():
            assert abs(r[name] - np.quantile(x, q)) < 1e-9, (g, name)
    assert quantiles.quantiles(df.where("false"), ["g"], "v", POINTS).count() == 0
    assert quantiles.quantiles(df, [], "v", {"q": 0.5}).first()["q"] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_no_buffer_of_distinct_values(spark):
    """The plan counts values and picks ranks; no aggregate gathers the values of a group."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = quantiles.summary(df, ["g"], "v", POINTS)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("few", [0, 50_000])
def test_numbers_of_rows_that_tie(spark, monkeypatch, few):
    monkeypatch.setattr(running, "FEW", few)
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4).alias("x"), (F.col("id") % 3).alias("g")).repartition(7)
    rows = running.numbered(df, [F.col("x")], "n", ["g"]).collect()
    for g in range(3):
        own = sorted((r.n, r.x) for r in rows if r.g == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)
    again = running.numbered(df.repartition(3), [F.col("x")], "n", ["g"]).collect()
    assert sorted(rows) == sorted(again)
