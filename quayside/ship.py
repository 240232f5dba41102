"""The package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application: functions that run there refer to it by name."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="quayside-"), "quayside.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(root)):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.join("quayside", os.path.relpath(path, root)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
