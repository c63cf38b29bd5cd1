"""Column-name normalisation, on the driver: names are metadata, not data."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def normalize_name(name: str, replacements: Iterable[tuple[str, str]] = ()) -> str:
    """snake_case: replacements in order, other characters to _, collapsed, stripped, lower-cased."""
    for old, new in replacements:
        name = name.replace(old, new)
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", name)).strip("_").lower()


def unique_names(names: Iterable[str], replacements: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """(original, normalised) pairs, repeated names numbered _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = normalize_name(name, replacements)
        seen[base] = seen.get(base, 0) + 1
        out.append((name, base if seen[base] == 1 else f"{base}_{seen[base]}"))
    return out


def rename_all(df: DataFrame, replacements: Iterable[tuple[str, str]] = ()) -> DataFrame:
    return df.toDF(*[new for _, new in unique_names(df.columns, replacements)])


def available(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of the requested columns that exist, in the requested order."""
    return [c for c in columns if c in df.columns]


def find_alias(df: DataFrame, aliases: Iterable[str]) -> str | None:
    """First column whose normalised name equals that of an alias."""
    by_name = {normalize_name(c): c for c in reversed(df.columns)}
    return next((by_name[n] for a in aliases if (n := normalize_name(a)) in by_name), None)
