"""Exact quantiles and moments by rank selection.

Equal values of a group are counted first (partial counts on the map side), running counts over the
values give every value its range of ranks, and the values at the two ranks around a quantile are picked
by one aggregate.  No task and no aggregate buffer holds the distinct values of a group, so one group may
be the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.running import running


def ranked(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, c (rows with it), upto (rows up to and including it): null values are left out; equal keys may be null."""
    c = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(c.cast("long").alias("c"))
    return running(counts, [F.col("value")], {"upto": "c"}, keys)


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def summary(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """keys, n, mean, std (sample), min, max and a column for each quantile (linear between ranks, as ``percentile``).

    Groups without any value have no row; the deviation of a single value is null.
    """
    rows = ranked(df, keys, value, weight)
    x, c = F.col("value").cast("double"), F.col("c")
    totals = rows.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"))
    at = rows.alias("r").join(totals.alias("t"), _same(keys, "r", "t")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "value", "c", "upto", "n", "mean")
    picks = []
    for name, q in points.items():
        place = F.lit(float(q)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), x)).alias(f"_{side}_{name}"))
    spread = F.sum(c * F.pow(x - F.col("mean"), 2))
    out = at.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), spread.alias("_spread"), F.min("value").alias("min"), F.max("value").alias("max"), *picks)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_spread") / (F.col("n") - 1))).alias("std")
    return out.select(*keys, "n", "mean", std, "min", "max", *[_between(name, q).alias(name) for name, q in points.items()])


def _between(name: str, q: float) -> Column:
    place = F.lit(float(q)) * (F.col("n") - 1)
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return F.when(F.floor(place) == F.ceil(place), low).when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """keys and a column for each quantile."""
    return summary(df, keys, value, points).select(*keys, *points)
