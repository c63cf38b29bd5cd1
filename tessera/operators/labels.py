"""Rule-based outcome labels and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.plans.specs import LabelSpec

#: Thresholds of the service-quality rules.
HIGH_LATENCY_MS, HIGH_JITTER_MS, LOW_RATIO, POOR_VIDEO = 150.0, 1.0, 0.35, 2.0


def add_labels(df: DataFrame, spec: LabelSpec) -> DataFrame:
    """Component columns and the outcome, all 0 or 1; unknown conditions count as 0."""
    parts = {name: exprs.holds(rule()).cast("int") for name, rule in spec.components.items()}
    df = df.withColumns(parts)
    return df.withColumn(spec.outcome, F.greatest(*[F.col(n) for n in parts]) if len(parts) > 1 else F.col(next(iter(parts))))


def service_labels(df: DataFrame) -> DataFrame:
    """Degradation of a measurement: latency, jitter, throughput shortfall, video, dropped or anomalous.

    The ratio of delivered to offered throughput is cut at 2 before the shortfall is taken; missing
    columns count as unknown, and unknown components as false.
    """
    have = set(df.columns)
    number = lambda c: exprs.numeric(c) if c in have else F.lit(None).cast("double")
    flag = lambda c: exprs.to_bool(c) if c in have else F.lit(False)
    df = df.withColumn("throughput_satisfaction_ratio", exprs.clip(exprs.safe_divide(number("download_speed_mbps"), number("offered_downlink_mbps")), 0.0, 2.0))
    df = df.withColumn("downlink_shortfall_fraction", exprs.clip(1 - F.col("throughput_satisfaction_ratio"), 0.0, 1.0))
    app = F.lower(F.col("app_type").cast("string")) if "app_type" in have else F.lit("")
    components = {
        "high_latency": number("latency_ms") >= HIGH_LATENCY_MS,
        "high_jitter": number("jitter_ms") >= HIGH_JITTER_MS,
        "downlink_service_shortfall": (F.col("throughput_satisfaction_ratio") <= LOW_RATIO) & number("offered_downlink_mbps").isNotNull(),
        "dropped_connection": flag("dropped_connection"),
        "anomalous": flag("anomalous"),
        "poor_video_quality": (app == "streaming") & (number("video_quality") <= POOR_VIDEO),
    }
    df = df.withColumns({k: exprs.holds(v) for k, v in components.items()})
    anyone = F.lit(False)
    for name in components:
        anyone = anyone | F.col(name)
    return df.withColumn("service_degraded", anyone.cast("int"))


def label_audit(df: DataFrame, labels: list[str]) -> DataFrame:
    """Positives and fraction of each label; review where none or all are positive."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y")) for c in labels])))
    out = long.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"), F.sum("y").alias("positive_count"))
    status = F.when((F.col("positive_count") == 0) | (F.col("positive_count") == F.col("row_count")), "review").otherwise("ok")
    return out.select("label", "row_count", "positive_count", (F.col("positive_count") / F.col("row_count")).alias("positive_fraction"), status.alias("status"))


def component_summary(df: DataFrame, components: list[str], outcome: str) -> DataFrame:
    """For each component: positives, positives that no other component explains, and its share of all positive outcomes."""
    total = F.lit(0)
    for c in components:
        total = total + F.col(c).cast("int")
    rows = df.withColumn("_fired", total)
    long = rows.select("_fired", F.col(outcome).cast("int").alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("int").alias("on")) for c in components])))
    out = long.groupBy("component").agg(F.sum("on").alias("positive_count"), F.count_if((F.col("on") == 1) & (F.col("_fired") == 1)).alias("unique_positive_count"), F.sum("y").alias("outcome_count"))
    return out.withColumn("share_of_outcome", F.when(F.col("outcome_count") > 0, F.col("positive_count") / F.col("outcome_count")))
