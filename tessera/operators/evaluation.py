"""Classification metrics from columns of truth (0/1), prediction (0/1) and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import running


def confusion(df: DataFrame, actual: str, predicted: str, copies: str | None = None) -> DataFrame:
    """All four cells, empty ones as 0."""
    a, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    one = df.agg(*[_rows_where((a == i) & (p == j), copies).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"c{i}{j}").alias("n")) for i in (0, 1) for j in (0, 1)])))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _rows_where(condition: Column, copies: str | None) -> Column:
    """Rows that meet a condition, each standing for ``copies`` rows where that column is named."""
    return F.count_if(condition) if copies is None else F.coalesce(F.sum(F.when(condition, F.col(copies))), F.lit(0)).cast("long")


def classification_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1; a zero denominator gives 0."""
    a, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    cells = df.groupBy(*keys).agg(*[_rows_where((a == i) & (p == j), copies).cast("double").alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return cells.select(*keys, _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"), _ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(df: DataFrame, actual: str, score: str, copies: str | None) -> DataFrame:
    """Positives and negatives at each distinct score, with what lies above, and the totals; scores are counted first."""
    y, c = F.col(actual).cast("long"), F.lit(1) if copies is None else F.col(copies)
    counts = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y * c).alias("p"), F.sum((1 - y) * c).alias("n"))
    above = running(counts, [F.desc("s")], {"tp": "p", "fp": "n"})
    return above.crossJoin(F.broadcast(above.agg(F.max("tp").alias("all_p"), F.max("fp").alias("all_n"))))  # one row of totals


def roc_auc(df: DataFrame, actual: str, score: str, copies: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    pairs = F.sum(F.col("p") * (F.col("all_n") - F.col("fp")) + F.col("p") * F.col("n") / 2)
    return _by_score(df, actual, score, copies).agg(F.round(_ratio(pairs, F.max("all_p") * F.max("all_n")), 9).alias("roc_auc"))


def average_precision(df: DataFrame, actual: str, score: str, copies: str | None = None) -> DataFrame:
    """Sum over score thresholds of the gain in recall times precision."""
    return _by_score(df, actual, score, copies).agg(F.round(F.sum(F.when(F.col("all_p") > 0, F.col("p") / F.col("all_p")).otherwise(0.0) * F.col("tp") / (F.col("tp") + F.col("fp"))), 9).alias("average_precision"))


def calibration(df: DataFrame, actual: str, probability: str, bins: int = 10, copies: str | None = None) -> DataFrame:
    """Rows, mean probability and observed rate in equal bins, the last one closed."""
    if copies is not None:
        c, known = F.col(copies), F.when(F.col(probability).isNotNull(), F.col(copies))
        cell = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
        return df.groupBy(cell.alias("bin")).agg(F.sum(c).alias("n"), F.round(F.sum(F.col(probability) * c) / F.sum(known), 9).alias("mean_probability"), (F.sum(F.col(actual).cast("long") * c) / F.sum(c)).alias("observed_rate"))
    cell = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(probability), 9).alias("mean_probability"), (F.sum(F.col(actual).cast("long")) / F.count(F.lit(1))).alias("observed_rate"))


def calibration_error(df: DataFrame, actual: str, probability: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    table = calibration(df, actual, probability, bins)
    ece = table.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed_rate"))) / F.sum("n"), 7).alias("ece"))
    brier = df.agg(F.round(F.avg(F.pow(F.col(probability) - F.col(actual), 2)), 9).alias("brier"))
    return ece.crossJoin(brier)  # one row each


def rank_models(metrics: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """Overall rank of models by several metrics, best first.  For reports of a few rows."""
    order = [F.desc(c) for c in by]
    return metrics.withColumn("overall_rank", F.row_number().over(Window.partitionBy().orderBy(*order, name)))


def repeated_summary(metrics: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of metrics over repetitions."""
    return metrics.groupBy(name).agg(F.count(F.lit(1)).alias("repetitions"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
