"""Arrivals as a stream: new files of a fact table, counted in event-time windows with late data, or handed on in batches."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.contract import Table


def arrivals(spark: SparkSession, root: str | Path, table: Table, files_per_batch: int = 1) -> DataFrame:
    """A stream of the rows in files that come into a table's folder, in the contract's columns."""
    return spark.readStream.schema(table.struct).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(str(Path(root) / table.name))


def windowed_counts(stream: DataFrame, event_date: str, late: str = "120 days", window: str = "30 days", *by: str) -> DataFrame:
    """Rows by event-time window (and columns); rows later than `late` behind the newest event are left out of the state."""
    timed = stream.withColumn("__t", F.col(event_date).cast("timestamp")).withWatermark("__t", late)
    counted = timed.groupBy(F.window("__t", window).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("date").alias("window_start"), F.col("w.end").cast("date").alias("window_end"), *by, "n")


def on_arrival(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls act for every batch of new rows once (a refresh, say), and ends when no file is left."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
