"""Bars made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type; (symbol, timestamp) is unique."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.expr("unix_seconds(cast(ts as timestamp)) div 3600 * 3600")
    by = e.groupBy(F.col("event_type").alias("symbol"), hour.alias("timestamp"))
    value, ts = F.col("value"), F.col("ts")
    return by.agg(F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("volume"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per line item; (symbol, timestamp) is not unique."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    return x.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.expr("unix_seconds(cast(l_shipdate as timestamp))").alias("timestamp"), price.alias("open"), (price + n).alias("high"), (price - n).alias("low"), price.alias("close"), n.cast("long").alias("volume"))
