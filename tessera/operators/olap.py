"""Descriptive mining: rates, crosstabs, frequencies, rollups, signatures.  Many tables come out of one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.names import available


def _rates(outcome: str) -> list[Column]:
    y = F.col(outcome).cast("long")
    return [F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("outcome_count"), (F.sum(y) / F.count(F.lit(1))).alias("outcome_rate")]


def group_rates(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """Rows, positives and rate of each value of a column; a missing column gives an empty table."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{column}` string, row_count long, outcome_count long, outcome_rate double")
    return df.groupBy(exprs.clean(column).alias(column)).agg(*_rates(outcome))


def all_group_rates(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Rates by each of several columns in one pass: group_column, group_value, counts, rate."""
    cells = F.array(*[F.struct(F.lit(c).alias("group_column"), exprs.clean(c).alias("group_value")) for c in available(df, columns)])
    return df.select(outcome, F.inline(cells)).groupBy("group_column", "group_value").agg(*_rates(outcome))


def with_wilson(rates: DataFrame) -> DataFrame:
    low, high = exprs.wilson("outcome_count", "row_count")
    return rates.withColumns({"ci_low": low, "ci_high": high})


def crosstabs(df: DataFrame, pairs: Sequence[tuple[str, str]], outcome: str) -> DataFrame:
    """Rates by each of several column pairs in one pass, long form."""
    cells = [F.struct(F.lit(a).alias("row_group"), F.lit(b).alias("column_group"), exprs.clean(a).alias("row_value"), exprs.clean(b).alias("column_value")) for a, b in pairs if a in df.columns and b in df.columns]
    return df.select(outcome, F.inline(F.array(*cells))).groupBy("row_group", "column_group", "row_value", "column_value").agg(*_rates(outcome))


def interaction_matrix(crosstab: DataFrame, row_group: str, column_group: str, values: Sequence[str]) -> DataFrame:
    """One crosstab as a matrix of rates: a row for each row value, a column for each listed column value."""
    one = crosstab.where((F.col("row_group") == row_group) & (F.col("column_group") == column_group))
    return one.groupBy("row_value").pivot("column_value", list(values)).agg(F.max("outcome_rate"))


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts and fractions of several columns, long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), exprs.clean(c).alias("value")) for c in available(df, columns)])
    counts = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("column_name")))


def kpis(df: DataFrame, outcome: str, session: str | None = None) -> DataFrame:
    """Long table of rows, positives, fraction and distinct sessions."""
    aggregates = [F.count(F.lit(1)).cast("double").alias("row_count"), F.coalesce(F.sum(F.col(outcome).cast("double")), F.lit(0.0)).alias("outcome_count"), F.coalesce(F.avg(F.col(outcome).cast("double")), F.lit(0.0)).alias("outcome_fraction")]
    if session in df.columns:
        aggregates.append(F.count_distinct(session).cast("double").alias("session_count"))
    one = df.agg(*aggregates)
    return one.unpivot([], one.columns, "metric", "value")


def rollup_stats(df: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """Rates at every level of a rollup; ``level`` is the number of keys that are summed over."""
    out = df.withColumns({k: exprs.clean(k) for k in keys}).rollup(*keys).agg(F.grouping_id().alias("gid"), *_rates(outcome))
    return out.withColumn("level", F.bit_count("gid").cast("int")).drop("gid")


def signature(rates: DataFrame, per_group: int = 5, limit: int = 24) -> DataFrame:
    """The highest rates of each grouping, then the highest of those."""
    order = [F.desc("outcome_rate"), F.desc("row_count"), F.col("group_value")]
    top = rates.withColumn("rank_in_group", F.row_number().over(Window.partitionBy("group_column").orderBy(*order))).where(F.col("rank_in_group") <= per_group)
    return top.orderBy(F.desc("outcome_rate"), F.desc("row_count"), "group_column", "group_value").limit(limit)


def bubble_sizes(df: DataFrame, value: str, low: float = 80.0, high: float = 560.0) -> DataFrame:
    """Min-max scaling to marker sizes; the midpoint where all values are equal.  For reports of a few rows."""
    least, most = F.min(value).over(Window.partitionBy()), F.max(value).over(Window.partitionBy())
    return df.withColumn("marker_size", F.when(most > least, low + (F.col(value) - least) / (most - least) * (high - low)).otherwise((low + high) / 2))
