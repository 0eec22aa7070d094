"""Structured Streaming into a table's log, and windowed bars of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BAR
from barloom.sources.log import append
from barloom.sources.store import Table


def ingest_stream(spark: SparkSession, root: str, name: str, folder: str, checkpoint: str) -> int:
    """Append every CSV file of a folder that has not been read yet, then stop; the rows written.

    The checkpoint remembers the files, so a rerun reads new ones only.
    """
    written = []
    files = spark.readStream.schema(BAR).option("header", True).option("mode", "FAILFAST").csv(folder)
    query = files.writeStream.foreachBatch(lambda df, _: written.append(append(df.sparkSession, Table(root, name), df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(written)


def windowed(bars: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Coarser bars of a (streaming) frame: one per symbol and time window; later rows than ``late`` are dropped."""
    timed = bars.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    w = F.window("at", width)
    return timed.groupBy("symbol", w.alias("window")).agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
