"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is set and one machine holds all tasks."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-staged-"))
    return _OWN[0]


def written(df: DataFrame, *partitions: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet and read back, with its path, which ``delete`` removes."""
    path = f"{folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, **options: str) -> DataFrame:
    """The same without the path, for what several parts of a plan need; it stays while the application may read it."""
    return written(df, **options)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders that ``written`` has named; nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
