import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs, names


def one(spark, column, *values, schema):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_clean_and_keys(spark):
    assert one(spark, exprs.clean("x"), " a ", "", None, schema="x string") == ["a", "<missing>", "<missing>"]
    assert one(spark, exprs.key_text("x", "boolean"), True, False, None, schema="x boolean") == ["True", "False", "<missing>"]


@pytest.mark.parametrize(
    ("prefix", "parts", "key"),
    [("area", ["Area_A", "Urban"], "area_a3617fc64f64"), ("environment", ["Clear", "High", "True"], "environment_fd762b954b1b"), ("time", ["0", "Friday", "False", "night"], "time_264f88247c0f"), ("application", ["Browse"], "application_2f3b5c55bc27")],
)
def test_published_keys(spark, prefix, parts, key):
    assert spark.range(1).select(exprs.surrogate_key(prefix, [F.lit(p) for p in parts])).first()[0] == key


def test_cut_is_right_closed(spark):
    edges, labels = [0.0, 50.0, 150.0, float("inf")], ["low", "moderate", "high"]
    assert one(spark, exprs.cut("x", edges, labels), 0.0, 50.0, 150.0, 151.0, -1.0, float("nan"), None, schema="x double") == ["low", "low", "moderate", "high", None, None, None]


def test_numbers(spark):
    assert one(spark, exprs.numeric("x"), "1.5", "x", "NaN", "Infinity", None, schema="x string") == [1.5, None, None, None, None]
    assert one(spark, exprs.safe_divide(F.lit(3.0), "x"), 2.0, 0.0, -1.0, None, schema="x double") == [1.5, None, None, None]
    assert one(spark, exprs.finite_clipped("x"), 9.0, -9.0, float("nan"), None, schema="x double") == [8.0, -8.0, 0.0, 0.0]
    assert one(spark, exprs.to_bool("x"), " YES ", "y", "no", "", None, schema="x string") == [True, True, False, False, False]


def test_items(spark):
    assert one(spark, exprs.item("time_of_day_bin", "x"), "late night", "nan", " ", None, "a;b,c", schema="x string") == ["time_of_day=late_night", None, None, None, "time_of_day=a_b_c"]
    assert one(spark, exprs.value_of("x"), "a=b=c", "a", schema="x string") == ["b=c", None]


def test_wilson(spark):
    low, high = exprs.wilson("k", "n")
    got = spark.createDataFrame([(5, 10), (0, 0), (0, 5), (5, 5)], "k int, n int").select(low, high).collect()
    assert [round(x, 4) for x in got[0]] == [0.2366, 0.7634]
    assert tuple(got[1]) == (0.0, 0.0) and got[2][0] == 0.0 and got[3][1] == 1.0


def test_times(spark):
    assert one(spark, exprs.time_of_day("x"), 0, 5, 6, 12, 18, 23, 24, None, schema="x int") == ["night", "night", "morning", "afternoon", "evening", "evening", "<missing>", "<missing>"]
    got = one(spark, exprs.parse_timestamp("x").isNull(), "2026.01.02_03.04.05", "2026-01-02 03:04:05", "2026/01/02 03:04:05", "?", None, schema="x string")
    assert got == [False, False, False, True, True]


def test_tokens(spark):
    assert one(spark, exprs.safe_token("x"), " A/B (c) ", "", None, "__", schema="x string") == ["a_b_c", "missing", "missing", "missing"]
    assert one(spark, exprs.technology("x"), "LTE + 5G", "GSM", "wifi", None, schema="x string") == ["lte", "2g", "unknown", "unknown"]


def test_names():
    assert [n for _, n in names.unique_names(["A b", "a_b", "A-B!", "Latency(ms)"])] == ["a_b", "a_b_2", "a_b_3", "latency_ms"]
    assert math.isfinite(exprs.Z95)
