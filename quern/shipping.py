"""Make this package importable where Python functions run."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Give workers the package's folder, as far as they share the driver's disk; elsewhere it is shipped with --py-files.

    Functions are captured with the environment of the moment, so this comes before they are made.
    """
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return  # the session's processes were started with it
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
