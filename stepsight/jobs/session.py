"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once for each application, unless PYTHONPATH has it there already."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-package-"), "stepsight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "stepsight").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
