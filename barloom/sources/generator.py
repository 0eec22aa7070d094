"""Synthetic bars: a seeded walk on the driver, and one for scale on the cluster."""

from __future__ import annotations

import csv
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.schema import COLUMNS

START, STEP, SEED = 1_704_067_200, 60, 7
#: Bars of one symbol whose running sums are made in one task.
RUN_ROWS = 100_000


def _check(symbols: list[str], rows: int, step: int) -> None:
    if not symbols or rows <= 0 or step <= 0:
        raise ValueError("symbols, rows and step must be given and positive")


def walk(symbols: list[str], rows: int, start: int = START, step: int = STEP, seed: int = SEED) -> Iterator[tuple]:
    """Bars in turn for each symbol; every price a text of 4 decimals.

    The order and ranges of the draws are fixed values: the published answers hold for these bars.
    """
    _check(symbols, rows, step)
    draw = random.Random(seed)
    price = [100.0 + 25 * k for k in range(len(symbols))]
    for i in range(rows):
        k = i % len(symbols)
        first = price[k]
        price[k] = last = max(0.01, first + draw.uniform(-1.25, 1.25))
        high = max(first, last) + draw.uniform(0, 0.75)
        low = min(first, last) - draw.uniform(0, 0.75)
        yield symbols[k], start + i * step, f"{first:.4f}", f"{high:.4f}", f"{low:.4f}", f"{last:.4f}", draw.randint(50_000, 5_000_000)


def write_csv(path: str, symbols: list[str], rows: int, start: int = START, step: int = STEP, seed: int = SEED) -> int:
    """The walk as a CSV file on the driver; the rows written."""
    _check(symbols, rows, step)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        out.writerows(walk(symbols, rows, start, step, seed))
    return rows


def spread(spark: SparkSession, symbols: list[str], rows: int, start: int = START, step: int = STEP, seed: int = SEED) -> DataFrame:
    """Bars made where they are used: a running sum of drifts per symbol.

    Draws are hashes of the row's number, so any partitioning gives the same bars. Running sums
    come in two steps, over runs of RUN_ROWS bars and within them: no task holds a whole symbol.
    """
    _check(symbols, rows, step)
    n = len(symbols)
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    k, run = (F.col("id") % n).cast("int"), F.expr(f"id div {n * RUN_ROWS}")
    r = spark.range(rows).select("id", k.alias("k"), run.alias("run"), (draw(0) * 2.5 - 1.25).alias("drift"), (draw(1) * 0.75).alias("up"), (draw(2) * 0.75).alias("down"), (F.floor(draw(3) * 4_950_001) + 50_000).alias("volume"))
    whole = r.groupBy("k", "run").agg(F.sum("drift").alias("inside"))
    earlier = F.coalesce(F.sum("inside").over(W.partitionBy("k").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    r = r.join(whole.select("k", "run", (100.0 + 25 * F.col("k") + earlier).alias("first")), ["k", "run"])
    along = W.partitionBy("k", "run").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("sum", F.col("first") + F.sum("drift").over(along))
    r = r.withColumn("close_", F.greatest(F.lit(0.01), "sum")).withColumn("open_", F.greatest(F.lit(0.01), F.col("sum") - F.col("drift")))
    price = lambda c: F.round(c, 4)
    return r.select(
        F.element_at(F.array(*map(F.lit, symbols)), F.col("k") + 1).alias("symbol"), (start + F.col("id") * step).alias("timestamp"), price(F.col("open_")).alias("open"),
        price(F.greatest("open_", "close_") + F.col("up")).alias("high"), price(F.least("open_", "close_") - F.col("down")).alias("low"), price(F.col("close_")).alias("close"), "volume",
    )
