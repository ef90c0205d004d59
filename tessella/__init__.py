"""Tessella: typed column operators and corpus operators expressed as Spark plans."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package wherever the driver was started.

    On a cluster the package is shipped as any other (--py-files); the path added here then just doesn't exist there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
