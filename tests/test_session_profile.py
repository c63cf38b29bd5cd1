"""Sessions in one aggregate: the same rows whatever the number of values of a category, and vectors that do not depend on the order of rows."""

import random

from pyspark.sql import functions as F

from tessera.operators import centres, clustering, sessions


def test_modes_of_few_and_of_many_values(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([None, *"stuvw"]), r.choice([None, 1.0, 2.5]), r.choice([None, "é", "b", "中", "B"]), r.choice([None, True, False]), None) for _ in range(300)] + [("alone", None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, x double, c string, d boolean, e string")
    few = sessions.session_profile(df, "s", ["x"], ["c", "d", "e"], [F.max("x").alias("most")])
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert few.columns == ["s", "record_count", "x", "c", "d", "e", "most"]
    for s, *found in few.collect():
        mine = [x for x in rows if x[0] == s]
        values = [[str(x[i]).lower() if i == 3 else x[i] for x in mine if x[i] is not None] for i in (2, 3, 4)]
        assert found[0] == len(mine) and found[2:5] == [min(set(v), key=lambda w: (-v.count(w), w.encode())) if v else None for v in values]
    monkeypatch.setattr(sessions, "FEW_VALUES", 2)
    some = sessions.session_profile(df, "s", ["x"], ["c", "d", "e"], [F.max("x").alias("most")])
    assert "Join" in some._jdf.queryExecution().optimizedPlan().toString()
    key = lambda row: str(row["s"])
    known = "s IS NOT NULL"
    assert some.columns == few.columns and sorted(some.where(known).collect(), key=key) == sorted(few.where(known).collect(), key=key)


def test_vectors_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"s{s}", r.randint(0, 99) / 100, r.choice("ab"), r.randint(0, 1)) for s in range(300) for _ in range(9)] + [(None, 1.0, "a", 1)]
    seen, sweep = [], centres.k_sweep

    def recorded(df, *args, **options):
        seen.append(sorted((x["s"], tuple(x["v"])) for x in df.collect()))
        return sweep(df, *args, **options)

    monkeypatch.setattr(centres, "k_sweep", recorded)
    found = []
    for _ in range(2):
        df = spark.createDataFrame(rows, "s string, x double, c string, y int").coalesce(1)
        found.append(sorted(clustering.session_clusters(df, "s", "y", ["x"], ["c"], [2, 3], 2)[1].collect()))
        rows.reverse()
    assert seen[0] == seen[1] and len(seen[0]) == 300
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
