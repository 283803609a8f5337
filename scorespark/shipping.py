"""Sends the package to executors that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package, served by the driver like any dependency."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="scorespark-zip-")) / "scorespark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _done.add(context.applicationId)
