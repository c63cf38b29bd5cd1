"""Star schema: hashed-key dimensions, fact table, star join, integrity.

Keys are hashes of the dimension's values, so a foreign key is a projection of the fact's own row
and building a fact table needs no join at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.names import available
from tessera.plans.specs import DimensionSpec, FactSpec


def key_of(df: DataFrame, spec: DimensionSpec) -> Column:
    """Surrogate key expression of a dimension over the columns that exist."""
    kinds = dict(df.dtypes)
    return exprs.surrogate_key(spec.key_prefix, [exprs.key_text(c, kinds[c]) for c in available(df, spec.columns)])


def build_dimension(df: DataFrame, spec: DimensionSpec) -> DataFrame:
    """Distinct values of the dimension with their id first; without any source column an empty table of ids."""
    columns = available(df, spec.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], f"`{spec.id_column}` string")
    rows = df.select(*columns).distinct()
    return rows.select(key_of(df, spec).alias(spec.id_column), *columns)


def build_fact(df: DataFrame, dimensions: Iterable[DimensionSpec], fact: FactSpec) -> DataFrame:
    """Identifiers, foreign keys and measures, in one projection; a dimension without source columns gives null keys."""
    keys = [(key_of(df, s) if available(df, s.columns) else F.lit(None).cast("string")).alias(s.id_column) for s in dimensions]
    return df.select(*available(df, fact.identifiers), *keys, *available(df, fact.measures))


def star_join(fact: DataFrame, dimensions: dict[str, DataFrame], wanted: Iterable[str] | None = None, validate: bool = False) -> DataFrame:
    """Left joins of a fact with its dimensions by their id columns.

    Dimensions that are not ``wanted`` are not joined.  ``validate`` raises on a repeated dimension
    key.  Whether a dimension is broadcast is left to the optimiser, which knows its size.
    """
    for id_column, dim in dimensions.items():
        if wanted is not None and id_column not in wanted or id_column not in fact.columns or id_column not in dim.columns:
            continue
        if validate and not dim.groupBy(id_column).count().where("count > 1").isEmpty():
            raise ValueError(f"{id_column} is not unique in its dimension")
        fact = fact.join(dim, id_column, "left")
    return fact


def integrity(fact: DataFrame, dimensions: dict[str, DataFrame], id_column: str) -> DataFrame:
    """Row counts, uniqueness and foreign-key completeness: check_name, check_value, status."""
    keys = [k for k in dimensions if k in fact.columns]
    facts = fact.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_column).alias("ids"), *[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    rows = [("fact_rows", F.col("rows"), F.col("rows") > 0), ("fact_duplicate_ids", F.col("rows") - F.col("ids"), F.col("rows") == F.col("ids"))]
    rows += [(f"missing_{k}", F.col(k), F.col(k) == 0) for k in keys]
    out = facts.select(F.inline(F.array(*[_row(*r) for r in rows])))
    for k in keys:
        dim = dimensions[k].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(k).alias("ids"))
        out = out.unionByName(dim.select(F.inline(F.array(_row(f"{k}_rows", F.col("rows"), F.lit(True)), _row(f"{k}_duplicates", F.col("rows") - F.col("ids"), F.col("rows") == F.col("ids"))))))
    return out


def _row(name: str, value: Column, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), value.cast("string").alias("check_value"), F.when(ok, "ok").otherwise("failed").alias("status"))


def column_coverage(df: DataFrame, specs: Iterable[DimensionSpec], fact: FactSpec) -> DataFrame:
    """Where each source column went: dimension, fact, or nowhere."""
    homes = {c: s.name for s in specs for c in s.columns} | {c: "fact" for c in (*fact.identifiers, *fact.measures)}
    rows = [(c, homes.get(c, "unused"), c in homes) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, warehouse_table string, is_covered boolean")
