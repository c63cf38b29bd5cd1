"""Sources and sinks: CSV and Parquet tables, inventories of raw files, conformed external sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.names import find_alias
from tessera.sources import records


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """CSV with a header; pass a schema to avoid the inference pass."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    df = df.select(*[c for c in columns if c in df.columns]) if columns is not None else df
    return df.limit(limit) if limit is not None else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; of the requested columns those that exist, which prunes the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = (), **options: str) -> str:
    """Parquet by default; CSV as an export.  Returns the path."""
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.parquet if kind == "parquet" else writer.option("header", True).option("escape", '"').csv)(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder; all that are missing are named in one FileNotFoundError."""
    if missing := [n for n in names if not exists(spark, f"{folder}/{n}.parquet")]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return {n: read_parquet(spark, f"{folder}/{n}.parquet") for n in names}


def first_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first file of that name: in the folders directly below, then anywhere below; by path."""
    bare = re.sub("^[a-z0-9+.-]+:", "", folder).strip("/")
    depth = F.size(F.split(F.regexp_replace("path", "^([a-z0-9+.-]+:)?/*", ""), "/"))
    found = inventory(spark, folder, name).orderBy((depth != len(bare.split("/")) + 2).cast("int"), "path").select("path").first()
    return found[0] if found else None


def simulator_files(spark: SparkSession, folder: str, outputs: Sequence[str]) -> DataFrame:
    """CSV files below a folder that are not outputs of the pipeline itself; text files are listed as such and not parsed."""
    files = inventory(spark, folder)
    name = F.substring_index("path", "/", -1)
    return files.where(F.col("kind").isin("csv", "txt") & ~name.isin(*outputs)).withColumn("parsed", F.col("kind") == "csv")


def write_text(lines: DataFrame, path: str) -> str:
    """One text column, in order, as a single text file (for reports)."""
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema if the path is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, bytes, kind, whether it is a supported table.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumns({"kind": kind, "is_table": kind.isin("csv", "parquet")})


def path_parts(path: Column, root: str) -> Column:
    """Folders of a file below a known root, as an array."""
    below = F.substring_index(path, f"/{root.strip('/')}/", -1)
    return F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))


def column_inventory(df: DataFrame, rows: int = 1000, examples: int = 3) -> DataFrame:
    """dtype, missing values and example values (JSON) of each column, from a bounded sample."""
    sample = df.limit(rows)
    one = sample.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns], *[F.to_json(F.slice(F.array_sort(F.collect_set(F.col(c).cast("string"))), 1, examples)).alias(f"e_{c}") for c in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"m_{c}").alias("missing_count"), (F.col(f"m_{c}") / F.col("_n")).alias("missing_fraction"), F.col(f"e_{c}").alias("examples")) for c, t in df.dtypes])))


def conform(df: DataFrame, mapping: dict[str, tuple[Sequence[str], str, float]], source: str) -> DataFrame:
    """Standard columns from aliases: target -> (aliases, type, factor); absent ones are null.  Names are resolved when the plan is made."""
    columns = []
    for target, (aliases, kind, factor) in mapping.items():
        found = find_alias(df, aliases)
        value = F.lit(None).cast(kind) if found is None else F.col(f"`{found}`").try_cast(kind)
        columns.append((value * F.lit(factor) if factor != 1 else value).alias(target))
    return df.select(F.lit(source).alias("source_dataset"), *columns)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL with absent columns as null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def fraction_from_percent(df: DataFrame, column: str, file: str) -> DataFrame:
    """Percent values to fractions, in files whose largest value is above 1.

    The largest value is an aggregate joined back, so a large file is not gathered in a window.
    """
    most = df.groupBy(file).agg(F.max(column).alias("_most"))
    out = df.join(most, file)
    return out.withColumn(column, F.when(F.col("_most") > 1, F.col(column) / 100).otherwise(F.col(column))).drop("_most")


def csv_rows(spark: SparkSession, path: str) -> int:
    """Records of all CSV files of a path without their headers; quoted line breaks do not count."""
    return records.csv_records(spark, path).agg(F.coalesce(F.sum(F.greatest(F.col("records") - 1, F.lit(0))), F.lit(0))).first()[0]


def raw_audit(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Manifest of datasets: exists, files, tables, bytes, status.  A missing or unreadable folder is a row, not an error."""
    out = None
    for name, folder in folders.items():
        if exists(spark, folder):
            row = inventory(spark, folder).agg(F.lit(name).alias("dataset"), F.lit(True).alias("exists"), F.count(F.lit(1)).alias("files"), F.count_if("is_table").alias("tables"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            row = row.withColumn("status", F.when(F.col("tables") > 0, "ok").otherwise("review"))
        else:
            row = spark.createDataFrame([(name, False, 0, 0, 0, "missing")], "dataset string, exists boolean, files long, tables long, bytes long, status string")
        out = row if out is None else out.unionByName(row)
    return out


def load_sources(spark: SparkSession, paths: dict[str, str], required: Sequence[str], standard: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """Union of the readable sources, and an audit of each: ok, missing_required or read_error, and the standard columns that it lacks."""
    frames, audit = [], []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except Exception as error:  # an unreadable source is a row of the audit
            audit.append((name, "read_error", type(error).__name__))
            continue
        absent = [c for c in required if c not in df.columns]
        audit.append((name, "missing_required" if absent else "ok", ",".join(absent or [c for c in standard if c not in df.columns])))
        if not absent:
            frames.append(df.select(F.lit(name).alias("source_dataset"), *[c for c in standard if c in df.columns]))
    return (union_sources(frames) if frames else None), spark.createDataFrame(audit, "source_dataset string, status string, detail string")


def manifest(tables: dict[str, DataFrame], kind: str = "parquet") -> DataFrame:
    """Name, kind and row count of artifacts, by name."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("artifact"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("row_count"))
        out = row if out is None else out.unionByName(row)
    return out


def expected_grid(spark: SparkSession, **levels: Sequence) -> DataFrame:
    """Every combination of a few levels, such as the runs that an experiment should have."""
    out = spark.range(1).select()
    for name, values in levels.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def scenario(name: Column, traffic: Column, scheduler: Column, seed: Column, path: Column) -> Column:
    """Given scenario, else traffic_scheduler_seed_n, else the folder of the file."""
    built = F.concat_ws("_", traffic, scheduler, F.lit("seed"), seed.cast("string"))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(traffic.isNotNull() & scheduler.isNotNull() & seed.isNotNull(), built), F.element_at(F.split(path, "/"), -2))


def first_existing(df: DataFrame, columns: Sequence[str]) -> Column:
    """The first of these columns that exists, by plan and not by row; null without any."""
    return next((F.col(c) for c in columns if c in df.columns), F.lit(None))


def any_known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one of the measures."""
    have = [F.col(c).cast("string") for c in columns if c in df.columns]
    return df.where(F.coalesce(*have).isNotNull()) if have else df.limit(0)
