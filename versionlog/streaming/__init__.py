"""Structured Streaming into a store: one atomic commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from versionlog.plans.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, *, order: str = "op_index", available_now: bool = True) -> StreamingQuery:
    """Write a stream of (order, key, value) rows; a null value deletes.

    The manifest records the last batch of ``name``, so a batch that is replayed after a
    failure is published once.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write_dataframe(batch, order, stream=(name, number))

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
