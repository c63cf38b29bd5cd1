"""Profiles of raw tables: missing values, distinct values, numeric summaries, cleaning audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import quantiles
from tessera.operators.running import numbered
from tessera.operators.staging import staged

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def strip_text(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.withColumns({c: F.trim(c) for c, t in df.dtypes if t == "string"})


def coerce_booleans(df: DataFrame) -> DataFrame:
    """Turn a string column into booleans if all its values are words for true or false.  Types depend on the data, so this runs one aggregate."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    fits = df.agg(*[F.bool_and(F.lower(F.trim(c)).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(c) for c in texts]).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), exprs.to_bool(c)) for c in texts if fits[c]})


def missingness(df: DataFrame) -> DataFrame:
    """column_name, dtype, missing_count, missing_fraction of every column, in one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(c).alias("missing_count"), F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(0.0).alias("missing_fraction")) for c, t in df.dtypes]
    return one.select(F.inline(F.array(*rows)))


def value_profile(df: DataFrame, max_values: int = 25) -> DataFrame:
    """Counts of the most frequent values of columns with few distinct ones."""
    distinct = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    few = [c for c in df.columns if distinct[c] <= max_values]
    if not few:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(exprs.MISSING)).alias("value")) for c in few])
    counts = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("r", rank).where(F.col("r") <= max_values).drop("r")


def dataset_summary(df: DataFrame, distinct: Sequence[str], timestamp: str | None = None) -> DataFrame:
    """Long table of rows, columns, distinct counts and the time range, as text."""
    aggregates = [F.count(F.lit(1)).cast("string").alias("rows"), F.lit(str(len(df.columns))).alias("columns")]
    aggregates += [F.count_distinct(c).cast("string").alias(f"distinct_{c}") for c in distinct]
    if timestamp:
        aggregates += [F.date_format(F.min(timestamp), "yyyy-MM-dd HH:mm:ss").alias("first_timestamp"), F.date_format(F.max(timestamp), "yyyy-MM-dd HH:mm:ss").alias("last_timestamp")]
    one = df.agg(*aggregates)
    return one.unpivot([], one.columns, "metric", "value")


def inferred_types(df: DataFrame) -> DataFrame:
    """column_name, source_type, inferred_type, non_null, from one aggregate over all columns.

    Of text the narrowest type that holds all known values: boolean (true, false), long, double, else string;
    integers are doubles and doubles are text.  Doubles that are all whole become long.  A column without any
    known value, and every other type, stays what it is.
    """
    cells = []
    for c, kind in df.dtypes:
        value = F.col(f"`{c}`")
        known = F.count(value)
        if kind == "string":
            text = F.trim(value)
            boolean = F.count_if(F.lower(text).isin("true", "false"))
            whole = F.count_if(text.rlike(r"^[+-]?[0-9]{1,18}$"))
            number = F.count_if(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"))
            found = F.when(known == 0, kind).when(boolean == known, "boolean").when(whole == known, "bigint").when(number == known, "double").otherwise(kind)
        elif kind in ("double", "float"):
            whole = F.count_if((F.abs(value) < 2.0**53) & (value == F.floor(value)))
            found = F.when((known > 0) & (whole == known), "bigint").otherwise(kind)
        else:
            found = F.lit(kind)
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("source_type"), found.alias("inferred_type"), known.alias("non_null")))
    return df.agg(F.array(*cells).alias("all")).select(F.inline("all"))


def converted(df: DataFrame) -> DataFrame:
    """Every column in its inferred type."""
    kinds = {r["column_name"]: r["inferred_type"] for r in inferred_types(df).collect()}  # one row a column
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if kind == "string" and kinds[c] != kind else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c, kind in df.dtypes])


def duplicate_audit(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows beyond the first of each key: n - distinct, nulls being equal to each other."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(*k)).alias(f"d{i}") for i, k in enumerate(keys)])
    rows = [F.struct(F.lit(",".join(k)).alias("key"), (F.col("n") - F.col(f"d{i}")).alias("duplicate_rows")) for i, k in enumerate(keys)]
    return one.select(F.inline(F.array(*rows)))


def numeric_summary(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """count, missing fraction, mean, sample deviation and quartiles of each column by group, long form."""
    long = df.select(exprs.clean(group).alias(group), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])))
    counts = staged(long.groupBy(group, "metric", "v").agg(F.count(F.lit(1)).alias("c")))
    all_rows = counts.groupBy(group, "metric").agg(F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("missing"), F.sum("c").alias("rows"))
    known = quantiles.summary(counts, [group, "metric"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, "c").alias("k")
    both = all_rows.alias("a").join(known, F.col(f"a.{group}").eqNullSafe(F.col(f"k.{group}")) & (F.col("a.metric") == F.col("k.metric")), "left")
    return both.select(
        f"a.{group}", "a.metric", F.coalesce("k.n", F.lit(0).cast("long")).alias("n"), (F.col("missing") / F.col("rows")).alias("missing_fraction"), F.round("k.mean", 6).alias("mean"), F.round("k.std", 6).alias("std"),
        "k.min", "k.q25", "k.median", "k.q75", "k.max",
    )


def range_audit(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows out of range for each rule, with a status."""
    one = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()], *[F.count(c).alias(f"n_{c}") for c in ranges])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.col(f"n_{c}").alias("n"), F.col(c).alias("out_of_range"), F.when(F.col(c) == 0, "ok").otherwise("review").alias("status")) for c, (lo, hi) in ranges.items()]
    return one.select(F.inline(F.array(*rows)))


def stable_ids(df: DataFrame, order: Sequence[str], prefix: str, width: int = 8) -> DataFrame:
    """Adds source_row_number, dense from 1 in the given order, and measurement_id, the prefix and the padded number.

    Rows that tie in the order get consecutive numbers.
    """
    out = numbered(df, [F.col(c) for c in order], "source_row_number")
    return out.withColumn("measurement_id", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("source_row_number").cast("string"), width, "0")))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population z-scores of a profile's columns; 0 where a column is constant, null stays null."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = df.crossJoin(F.broadcast(stats))  # one row
    score = lambda c: F.when(F.col(c).isNull(), None).when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return rows.select(*[c for c in df.columns if c not in columns], *[score(c).alias(c) for c in columns])
