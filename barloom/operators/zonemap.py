"""Statistics of chunks and blocks: row count, symbols, least and largest of every number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import BAR, NUMERIC

_LONG = T.LongType()
_ENDS = [T.StructField(f"{c}_{e}", BAR[c].dataType) for c in NUMERIC for e in ("min", "max")]
_SHARED = [T.StructField("row_count", _LONG), T.StructField("symbols", T.ArrayType(T.StringType())), *_ENDS]
#: The two tables of statistics, so that reading them needs no look at their files first.
CHUNK_TABLE = T.StructType([T.StructField("chunk_id", _LONG), *_SHARED])
BLOCK_TABLE = T.StructType([T.StructField("chunk_id", _LONG), T.StructField("block_id", _LONG), T.StructField("row_start", _LONG), *_SHARED])


def _summary() -> list:
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in NUMERIC for f in (F.min, F.max)]
    return [F.count(F.lit(1)).alias("row_count"), F.sort_array(F.collect_set("symbol")).alias("symbols"), *ends]


def chunk_statistics(placed: DataFrame) -> DataFrame:
    return placed.groupBy("chunk_id").agg(*_summary())


def block_statistics(placed: DataFrame) -> DataFrame:
    """Also row_start: where in its chunk a block begins."""
    first = F.min(F.struct("rn", "block_id"))["rn"]
    rows = placed.groupBy("chunk_id", "block_id").agg(first.alias("_first"), *_summary())
    starts = placed.groupBy("chunk_id").agg(F.min("rn").alias("_chunk_first"))
    return rows.join(starts, "chunk_id").withColumn("row_start", F.col("_first") - F.col("_chunk_first")).drop("_first", "_chunk_first")


def chunks_of_blocks(blocks: DataFrame) -> DataFrame:
    """Chunk statistics from those of their blocks."""
    ends = [f(f"{c}_{f.__name__}").alias(f"{c}_{f.__name__}") for c in NUMERIC for f in (F.min, F.max)]
    symbols = F.sort_array(F.array_distinct(F.flatten(F.collect_set("symbols"))))
    return blocks.groupBy("chunk_id").agg(F.sum("row_count").alias("row_count"), symbols.alias("symbols"), *ends)


def whole_chunks_as_blocks(chunks: DataFrame) -> DataFrame:
    """For chunks without block statistics: one block that is the chunk."""
    return chunks.withColumn("block_id", F.lit(0).cast("long")).withColumn("row_start", F.lit(0).cast("long"))
