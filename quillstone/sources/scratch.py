"""Folders for derived tables: in the shared folder of the session, removed when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

from . import files

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; off a single machine it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints/quillstone").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        for path in _made.get(spark.sparkContext.applicationId, []):
            files.remove(spark, path)
    except Exception:  # the session may be gone already; what is left is only disk
        return
