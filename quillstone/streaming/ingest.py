"""Continuous inserts: a stream's batches become table parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def insert_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert each micro-batch; a batch that is run again finds its keys present and adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        engine.insert(table, batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
