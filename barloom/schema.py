"""The one table schema: a market bar."""

from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("timestamp", T.LongType(), False),
    *[T.StructField(c, T.DoubleType(), False) for c in ("open", "high", "low", "close")],
    T.StructField("volume", T.LongType(), False),
])
COLUMNS = BAR.names
WHOLE = ("timestamp", "volume")
PRICES = ("open", "high", "low", "close")
NUMERIC = tuple(c for c in COLUMNS if c != "symbol")
GROUPABLE = ("symbol",)
#: Sort keys of the two physical layouts.
LAYOUTS = {"time": ("timestamp", "symbol"), "symbol_time": ("symbol", "timestamp")}
CHUNK_ROWS, BLOCK_ROWS = 10_000, 1024
