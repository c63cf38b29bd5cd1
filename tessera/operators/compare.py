"""Comparison of distributions across sources: long frames, summaries, coverage, KS and Wasserstein distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import quantiles
from tessera.operators.running import running
from tessera.operators.staging import staged
from tessera.plans.specs import MetricSpec

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def long_frame(df: DataFrame, source: str, metrics: Sequence[MetricSpec], context: str | None = None) -> DataFrame:
    """source, metric, value: finite values only, restricted where a metric names a context for the source."""
    cells = []
    for m in metrics:
        value = exprs.numeric(m.column) if m.column in df.columns else F.lit(None).cast("double")
        for where, wanted in m.only.items():
            value = F.when((F.col(source) != where) | (F.col(context) == wanted), value)
        cells.append(F.struct(F.lit(m.name).alias("metric"), value.alias("value")))
    return df.select(F.col(source).alias("source"), F.inline(F.array(*cells))).where("value IS NOT NULL")


def distribution_summary(long: DataFrame, keys: Sequence[str] = ("source", "metric")) -> DataFrame:
    """n, mean, deviation, exact quantiles and interquartile range of each group."""
    out = quantiles.summary(long, keys, "value", QUANTILES)
    return out.select(*keys, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", *[F.round(k, 9).alias(k) for k in QUANTILES], "max", F.round(F.col("p75") - F.col("p25"), 9).alias("iqr"))


def coverage(df: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """Rows and non-missing count and fraction of each column by source, wide."""
    out = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(f"{c}_n") for c in columns])
    return out.withColumns({f"{c}_fraction": F.col(f"{c}_n") / F.col("row_count") for c in columns})


def context_coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each combination of context values; null is a value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def readiness(long: DataFrame, main: str, sources: Sequence[str], metrics: Sequence[str], least: int = 20) -> DataFrame:
    """Status of every metric and source, present or not: available, insufficient, reference_only or pairwise_comparable."""
    spark = long.sparkSession
    grid = spark.createDataFrame([(m, s) for m in metrics for s in sources], "metric string, source string")
    counts = long.groupBy("metric", "source").agg(F.count(F.lit(1)).alias("n"))
    mains = counts.where(F.col("source") == main).select("metric", F.col("n").alias("main_n"))
    out = grid.join(counts, ["metric", "source"], "left").join(mains, "metric", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "main_n": F.coalesce("main_n", F.lit(0))})
    status = (
        F.when(F.col("n") == 0, "missing").when(F.col("n") < least, "insufficient").when(F.col("source") == main, "available")
        .when(F.col("main_n") < least, "reference_only").otherwise("pairwise_comparable")
    )
    return out.select("metric", "source", "n", status.alias("status"))


def pairwise_distances(long: DataFrame, main: str, least: int = 20) -> DataFrame:
    """Main source against every other: counts, medians, Kolmogorov-Smirnov statistic and p-value, Wasserstein-1.

    Equal values are counted first, and running sums need no task that sees a whole pair.  The area
    between the distributions is summed at their steps: a value times the fall of the gap there.
    """
    counts = staged(long.groupBy("metric", "source", "value").agg(F.count(F.lit(1)).alias("c")))
    refs = counts.where(F.col("source") != main).select("metric", F.col("source").alias("reference"), "value", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    pairs = refs.select("metric", "reference").distinct()
    mains = counts.where(F.col("source") == main).select("metric", "value", F.col("c").alias("a"), F.lit(0).cast("long").alias("b")).join(pairs, "metric").select("metric", "reference", "value", "a", "b")
    points = refs.unionByName(mains).groupBy("metric", "reference", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    summed = running(points, [F.col("value")], {"ra": "a", "rb": "b"}, ["metric", "reference"])
    whole = summed.groupBy("metric", "reference").agg(F.max("ra").alias("na"), F.max("rb").alias("nb")).where((F.col("na") >= least) & (F.col("nb") >= least))
    gap = lambda a, b: F.abs(a / F.col("na") - b / F.col("nb"))
    at, left = gap(F.col("ra"), F.col("rb")), gap(F.col("ra") - F.col("a"), F.col("rb") - F.col("b"))
    out = summed.join(whole, ["metric", "reference"]).groupBy("metric", "reference").agg(F.max("na").alias("n_main"), F.max("nb").alias("n_reference"), F.round(F.max(at), 9).alias("ks"), F.round(F.sum(F.col("value") * (left - at)), 6).alias("wasserstein"))
    medians = staged(quantiles.summary(counts, ["metric", "source"], "value", {"m": 0.5}, "c").select("metric", "source", "m"))
    out = out.join(medians.where(F.col("source") == main).select("metric", F.col("m").alias("median_main")), "metric").join(medians.select("metric", F.col("source").alias("reference"), F.col("m").alias("median_reference")), ["metric", "reference"])
    return out.withColumns({"median_difference": F.round(F.col("median_main") - F.col("median_reference"), 9), "median_ratio": F.round(exprs.median_ratio("median_main", "median_reference"), 9)})


def ks_p_value(ks: str, n: str, m: str, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample statistic, by the Kolmogorov series."""
    size = F.sqrt(F.col(n) * F.col(m) / (F.col(n) + F.col(m)))
    x = (size + 0.12 + 0.11 / size) * F.col(ks)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def metric_support(coverage_long: DataFrame, main_text: str = "main_text") -> DataFrame:
    """For each metric: sources that hold it, their values, and how many sources are recommended for the main text."""
    return coverage_long.groupBy("metric").agg(F.count_distinct("source").alias("sources"), F.sum("n").alias("values"), F.count_if(F.col("recommended_use") == main_text).alias("main_text_sources"))


def filter_audit(long: DataFrame, metrics: Sequence[MetricSpec]) -> DataFrame:
    """Which sources a metric was restricted in, to which context, and how many values are left."""
    notes = [(m.name, s, c) for m in metrics for s, c in m.only.items()]
    named = long.sparkSession.createDataFrame(notes, "metric string, source string, only_context string")
    counts = long.groupBy("metric", "source").agg(F.count(F.lit(1)).alias("n"))
    return named.join(counts, ["metric", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def audit_notes(long: DataFrame, distances: DataFrame, main: str) -> DataFrame:
    """Notes on a comparison: main values, sources, comparisons made, and metrics that only one source holds."""
    by_metric = long.groupBy("metric").agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("source") == main).alias("main_values"))
    notes = by_metric.select(F.inline(F.array(
        F.struct(F.concat(F.lit("sources of "), "metric").alias("note"), F.col("sources").cast("long").alias("n"), F.when(F.col("sources") > 1, "ok").otherwise("review").alias("status")),
        F.struct(F.concat(F.lit("values of main in "), "metric").alias("note"), F.col("main_values").cast("long").alias("n"), F.when(F.col("main_values") > 0, "ok").otherwise("review").alias("status")),
    )))
    made = distances.agg(F.lit("comparisons made").alias("note"), F.count(F.lit(1)).alias("n")).withColumn("status", F.when(F.col("n") > 0, "ok").otherwise("review"))
    return notes.unionByName(made)
