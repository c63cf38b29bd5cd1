"""A registry of tables in YAML: where each lies, in which format, and which columns it must have.

    tables:
      orders: {path: orders.parquet, required: [o_orderkey]}
      notes:  {path: notes.csv, format: csv, schema: "id long, note string"}
"""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession

from tessera.sources import tables


@dataclass(frozen=True)
class Entry:
    """One table of a registry."""

    path: str
    format: str = "parquet"
    schema: str | None = None
    required: tuple[str, ...] = ()
    optional: bool = False


def parse(text: str) -> dict[str, Entry]:
    """Entries by name; anything but mappings where mappings belong is a ValueError."""
    found = yaml.safe_load(text)
    listed = found.get("tables", {}) if isinstance(found, dict) else None
    if not isinstance(listed, dict) or not all(isinstance(e, dict) and "path" in e for e in listed.values()):
        raise ValueError("a registry is a mapping whose 'tables' map names to mappings with a path")
    return {name: Entry(**{**e, "required": tuple(e.get("required", ()))}) for name, e in listed.items()}


def read(spark: SparkSession, path: str) -> dict[str, Entry]:
    """The registry in a file that Spark can read; paths in it are below the file's folder unless they are absolute."""
    text = spark.read.text(path, wholetext=True).first()
    base = path.rpartition("/")[0]
    entries = parse(text[0] if text else "")
    return {n: e if e.path.startswith("/") or "://" in e.path else Entry(f"{base}/{e.path}", e.format, e.schema, e.required, e.optional) for n, e in entries.items()}


def open_table(spark: SparkSession, entry: Entry) -> DataFrame:
    """The table; a ValueError names the required columns that it lacks.  An optional one that is missing is empty."""
    if entry.optional and entry.schema and not tables.exists(spark, entry.path):
        return spark.createDataFrame([], entry.schema)
    df = tables.read_csv(spark, entry.path, entry.schema) if entry.format == "csv" else tables.read_parquet(spark, entry.path)
    if absent := [c for c in entry.required if c not in df.columns]:
        raise ValueError(f"{entry.path} lacks {', '.join(absent)}")
    return df


def dump(entries: dict[str, Entry]) -> str:
    """YAML that ``parse`` reads back."""
    return yaml.safe_dump({"tables": {n: {"path": e.path, "format": e.format, **({"schema": e.schema} if e.schema else {}), "required": list(e.required), "optional": e.optional} for n, e in entries.items()}}, sort_keys=False)
