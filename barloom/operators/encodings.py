"""Column encodings as frames, and row ranges. Parquet does the physical work; these state the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.sources.store import staged


def dictionary(placed: DataFrame, column: str = "symbol") -> DataFrame:
    """Per chunk, each value's id in order of first appearance: chunk_id, value, id."""
    seen = placed.groupBy("chunk_id", F.col(column).alias("value")).agg(F.min("rn").alias("_first"))
    at = F.row_number().over(W.partitionBy("chunk_id").orderBy("_first")) - 1
    return seen.select("chunk_id", "value", at.cast("long").alias("id"))


def dictionary_ids(placed: DataFrame, column: str = "symbol") -> DataFrame:
    """rn, chunk_id and the id of each row's value."""
    return placed.select("rn", "chunk_id", F.col(column).alias("value")).join(dictionary(placed, column), ["chunk_id", "value"]).select("rn", "chunk_id", "id")


def dictionary_values(ids: DataFrame, words: DataFrame) -> DataFrame:
    """Back from ids: rn, chunk_id, value."""
    return ids.join(words, ["chunk_id", "id"]).select("rn", "chunk_id", "value")


def offsets(placed: DataFrame, column: str = "timestamp") -> DataFrame:
    """rn, chunk_id, the chunk's base (its first value) and each row's distance from it (may be negative). Without rows there is no base: ValueError."""
    if placed.isEmpty():
        raise ValueError("offsets need a first value")
    first = placed.groupBy("chunk_id").agg(F.min_by(column, "rn").alias("base"))
    return placed.join(first, "chunk_id").select("rn", "chunk_id", "base", (F.col(column) - F.col("base")).alias("offset"))


def from_offsets(encoded: DataFrame) -> DataFrame:
    return encoded.select("rn", "chunk_id", (F.col("base") + F.col("offset")).alias("value"))


def plain(placed: DataFrame, *columns: str) -> DataFrame:
    """rn, chunk_id and columns, written once as 64-bit numbers without a dictionary and read back."""
    return staged(placed.select("rn", "chunk_id", *columns), "plain", {"parquet.enable.dictionary": "false"})[0]


def mask(column: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> Column:
    """1 where a value lies between the bounds (either may be missing), else 0."""
    c, inside = F.col(column), F.lit(True)
    if low is not None:
        inside &= c >= F.lit(low) if include_low else c > F.lit(low)
    if high is not None:
        inside &= c <= F.lit(high) if include_high else c < F.lit(high)
    return inside.cast("int")


def row_range(placed: DataFrame, start: int, stop: int, rows: int | None = None) -> DataFrame:
    """Rows start <= rn < stop. Bounds that are negative, reversed or past the end raise."""
    rows = placed.count() if rows is None else rows
    if start < 0 or stop < start or stop > rows:
        raise ValueError(f"{start}:{stop} is no range within {rows} rows")
    return placed.where((F.col("rn") >= start) & (F.col("rn") < stop))
