"""Send this package to the executors, so that Python workers can import it wherever the job was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Add a zip of the package to the job, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-ship-")), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
