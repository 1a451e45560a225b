"""Shared storage: where lineage is cut, so that jobs survive lost executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on a single machine (tests).
DEFAULT_DIR = "file:///tmp/checkpoints/quillstone"
_made: dict[str, list[str]] = {}
_CLEAN, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; off a single machine it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or DEFAULT_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if len(_made) == 1 and sum(map(len, _made.values())) == 1:
        atexit.register(_remove)
    return path


@contextmanager
def _set(spark: SparkSession, **values: str | None) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k, v in values.items() if v is not None}
    try:
        for k in before:
            spark.conf.set(k, values[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: later steps never recompute it.

    The shuffle files of the step are dropped as soon as its table stands. batch: rows in an Arrow
    batch while the step runs, if the session still has the default.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _set(spark, **{_CLEAN: "true", _BATCH: str(batch) if batch and spark.conf.get(_BATCH) == "10000" else None}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has (case aside)."""
    taken = {x.lower() for x in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fresh(table: DataFrame) -> DataFrame:
    """The saved table read anew, with columns of its own: for joins of a table with itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._saved_at)


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_saved_at", None) if "_saved_at" in vars(table) else None
        if path:
            spark = table.sparkSession
            _delete(spark, path)
            _made[spark.sparkContext.applicationId].remove(path)
            del table._saved_at


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        for path in _made.get(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # the session may be gone already; what is left is only disk
        return
