"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="quillstone-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark
