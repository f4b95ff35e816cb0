"""Cleaning documents as they arrive: a landing folder, stateless transforms, an idempotent sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import landing_stream


def clean_stream(spark: SparkSession, folder: str, cleaner, pattern: str = "*.txt") -> DataFrame:
    """The arriving documents with ``cleaner`` (a column function) applied.  Every document stands
    alone, so there is no state and no watermark."""
    c: Column = cleaner("text")
    return landing_stream(spark, folder, pattern).withColumn("text", c)


def start(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Writes each micro-batch once: a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("error", F.when(F.col("text").isNull(), "unreadable")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
