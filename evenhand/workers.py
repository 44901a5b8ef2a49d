"""Getting this package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to all workers, once a session: functions that run there are found by module name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="evenhand-")  # Spark's file server reads it as long as the session lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
