"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  Only where it is unset, as in tests on one machine, a
folder of our own takes its place.  A frame that an operator returns may read these tables, so they
stay until ``clear`` or the end of a ``scope``.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []


def base(spark: SparkSession) -> str:
    """The shared folder, as a path or URI for Spark."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return _OWN[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls return the same."""
    _WRITTEN.append(os.path.join(base(spark), f"tessera-{name}-{uuid.uuid4().hex}"))
    return _WRITTEN[-1]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that this module has named."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def clear(spark: SparkSession) -> None:
    """Remove all that was written so far; frames that still read it can no longer be used."""
    delete(spark, _WRITTEN[:])


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end what was written inside, but for the paths put into the list that is given."""
    before, keep = set(_WRITTEN), []
    try:
        yield keep
    finally:
        delete(spark, [p for p in _WRITTEN if p not in before and p not in keep])


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back, with its path: lineage is cut, and an executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The same without the path.

    With ``release``, shuffle files that nothing needs any more go now: Spark removes them when neither
    Python nor the driver's JVM refers to them, which by itself may take half an hour to be noticed.
    """
    out = written(df, name)[0]
    if release:
        for _ in range(2):  # Python's references reach the JVM with a delay, so what they held goes in the second round
            gc.collect()
            df.sparkSession.sparkContext._jvm.System.gc()
            time.sleep(0.2)
    return out


def free(columns: list[str], *names: str) -> list[str]:
    """Names for columns that an operator adds for a while: those given, made longer until no input column has them in any letter case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
