"""Incremental forms, an extension of our own: file streams, late rows, sessions, stateful counters.

Deliveries arrive as files; repeated ones are dropped within a watermark, and each micro-batch is
appended once, keyed by its batch number, so a restarted job repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, key: str, time: str, late: str = "120 days") -> DataFrame:
    """Each key once; state is kept for ``late``, longer than any delivery is expected to lag."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def append(stream: DataFrame, target: str, checkpoint: str, partition: list[str] | None = None):
    """Append every micro-batch under its own number; a batch that runs again overwrites only itself."""

    def write(batch: DataFrame, number: int) -> None:
        w = batch.write.mode("overwrite")
        (w.partitionBy(*partition) if partition else w).parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, by, n) in tumbling windows, late rows counted within the watermark."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n): runs of a user's events with no longer pause than ``gap``; for streams and tables."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_t", gap)
    g = e.groupBy(F.session_window("_t", gap).alias("w"), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counts(stream: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """(key, n, last): counts kept in state over micro-batches, by an Arrow stateful function."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            n += len(b)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long", "n long", "update", "NoTimeout")
