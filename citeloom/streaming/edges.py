"""Incremental citation counts with Structured Streaming (an extension; the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def velocity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Citations per cited node and window, counted once per event. events: ts, event_id, dst.

    Events later than ``late`` behind the newest are dropped; a window is final once it is that old.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "dst").agg(F.count(F.lit(1)).alias("citations")).select(F.col("w.start").alias("start"), "dst", "citations")


def keep_degrees(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's in-degree deltas under its batch number: a batch sent again replaces itself.

    edges: src, dst, distinct within the stream. Read the counts with ``degrees``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degrees(spark, path: str) -> DataFrame:
    """id, in_degree over all batches written so far."""
    return spark.read.parquet(path).groupBy("id").agg(F.sum("n").alias("in_degree"))
