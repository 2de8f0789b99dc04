"""The package on the workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, so that functions run wherever a worker starts."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as own:
            whole = Path(own) / "whole"
            shutil.copytree(package, whole / package.name, ignore=shutil.ignore_patterns("__pycache__"))
            kept = Path(tempfile.mkdtemp(prefix="spark-"))  # the driver serves it as long as the session lives
            spark.sparkContext.addPyFile(shutil.make_archive(str(kept / package.name), "zip", whole))
        _SHIPPED.add(app)
