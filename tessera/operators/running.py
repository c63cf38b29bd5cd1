"""Running totals and dense numbers over a whole order, without a task that sees all rows.

The rows are staged first.  A table of at most ``FEW`` rows gets one window.  A larger one is dealt out
by ranges of the order and staged again, so that a rerun deals it alike; a window runs inside each
range, and the totals of the ranges before it, one row for each range and key, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.staging import staged

PART = "_range"
#: Rows that one window may hold.
FEW = 50_000


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``sums`` (new column: summed column), each up to and including its row in ``order``, from zero again for each combination of ``keys``.

    Rows that tie in ``order`` are summed one by one, in the order of a hash of the row.
    """
    held, order = staged(df), [*order, F.xxhash64(*df.columns)]  # so that rows that tie come in the same order in every run
    if held.count() <= FEW:
        inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return held.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    parted = staged(held.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(PART, F.spark_partition_id()))
    totals = parted.groupBy(PART, *keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = totals.select(F.col(PART).alias("_part"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(PART) == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    rows = parted.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    return rows.join(before, same).select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds a dense number from 1 in ``order``, within ``keys``."""
    one = "_one"
    return running(df.withColumn(one, F.lit(1).cast("long")), order, {name: one}, keys).drop(one)
