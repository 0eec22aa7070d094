"""The physical order of rows: a dense global row number, then chunks and blocks of fixed size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import BLOCK_ROWS, CHUNK_ROWS, LAYOUTS
from barloom.sources import store

#: Rows that one sorting task takes, roughly.
SORT_ROWS = 2_000_000


def number_rows(bars: DataFrame, layout: str) -> DataFrame:
    """bars with rn = 0, 1, ... in the order of a layout; ties by the ingest order, if bars have it.

    Rows are range partitioned and sorted, written once (so that every later use
    sees the same partitions) and numbered by the partitions' sizes: no task
    sorts all rows, and the driver sees one number per partition.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    spark = bars.sparkSession
    keys = [*LAYOUTS[layout], *(c for c in ("_batch", "_row") if c in bars.columns)]
    parts = max(1, math.ceil(bars.count() / SORT_ROWS), min(spark.sparkContext.defaultParallelism, 8))
    ordered = bars.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept, path = store.staged(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), f"sorted-{layout}")
    sizes = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append((p, total))
        total += sizes.get(p, 0)
    known = spark.createDataFrame(offsets, "_part int, _before long")  # a row per partition
    return kept.join(F.broadcast(known), "_part").withColumn("rn", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def with_chunks(numbered: DataFrame, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds chunk_id and block_id (within the chunk) by row number."""
    return numbered.withColumn("chunk_id", F.expr(f"rn div {chunk_rows}")).withColumn("block_id", F.expr(f"(rn % {chunk_rows}) div {block_rows}"))
