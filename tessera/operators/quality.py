"""Audits: named checks with a textual value and a status, evaluated in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """An aggregate, and the condition on its value (column ``v``) under which the check is ok."""

    name: str
    value: Column
    ok: Column | None = None
    otherwise: str = "failed"


def audit(df: DataFrame, checks: list[Check]) -> DataFrame:
    """check_name, check_value (text), status; one pass over ``df``."""
    one = df.agg(*[c.value.alias(f"v{i}") for i, c in enumerate(checks)])
    rows = [
        F.struct(F.lit(c.name).alias("check_name"), F.col(f"v{i}").cast("string").alias("check_value"), (F.lit("ok") if c.ok is None else F.when(c.ok, "ok").otherwise(c.otherwise)).alias("status"))
        for i, c in enumerate(checks)
    ]
    return one.select(F.inline(F.array(*rows)))


def v(i: int) -> Column:
    """Value of check number i, for conditions."""
    return F.col(f"v{i}")


def raise_on_failed(checks: DataFrame) -> DataFrame:
    """The audit itself, or an error that names the failed checks."""
    failed = [r["check_name"] for r in checks.where(F.col("status") == "failed").select("check_name").limit(50).collect()]
    if failed:
        raise ValueError(f"failed checks: {', '.join(failed)}")
    return checks
