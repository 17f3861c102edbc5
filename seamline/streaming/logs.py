"""Retrieval logs as a stream: windowed counts with late data, and incremental merge of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import StateStore, content_hash


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def merge_changed(stream: DataFrame, store: StateStore, columns: list[str], name: str = "stream"):
    """Start a query that commits each micro-batch's new or changed rows to ``store.outputs()``.

    Rows, their state and the batch's epoch become visible in one swap: a batch
    that is retried after a failure is skipped if it was committed and done
    again as a whole if not, so every row comes out exactly once. ``name``
    identifies the stream in the store and must go with its checkpoint.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        if epoch <= store.epoch(name):
            return
        todo = store.changed(content_hash(batch, columns)).persist()
        try:
            store.commit(todo, output=todo, stream=name, epoch=epoch)
        finally:
            todo.unpersist()

    return stream.writeStream.foreachBatch(step)
