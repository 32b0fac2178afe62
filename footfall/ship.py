"""Make this package importable in Python workers on other machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_footfall_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "footfall.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, f"footfall/{path.relative_to(top)}")
    context.addPyFile(str(target))
    context._footfall_shipped = True
