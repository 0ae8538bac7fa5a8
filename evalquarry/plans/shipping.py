"""The package on the executors, for operators that run Python functions there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Spark distributes the file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="evalquarry-core-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "evalquarry_core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in (root / "evalquarry").rglob("*.py"):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
