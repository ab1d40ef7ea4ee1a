"""Gives the executors this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if not getattr(context, "_seamgraph_shipped", False):
        top = Path(__file__).parent.parent
        at = Path(tempfile.mkdtemp(prefix="seamgraph-"), "seamgraph.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        context.addPyFile(str(at))
        context._seamgraph_shipped = True
    return spark
