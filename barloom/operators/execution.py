"""A query over a compacted table: pruned chunks, row groups skipped by statistics, exact filter, aggregates."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.scan import MATCHED, run
from barloom.plans.planner import plan as make_plan
from barloom.plans.planner import pushdown, work_of
from barloom.plans.spec import Metrics, Plan, Query, Result
from barloom.schema import BAR, WHOLE
from barloom.sources.store import Table

_STORED = T.StructType([*BAR.fields, T.StructField("rn", T.LongType()), T.StructField("chunk_id", T.LongType())])
#: Runs of chunks named in a partition filter; beyond, the scan is joined with the surviving ids.
MOST_NAMED = 2000
#: Chunks that are read by their own paths.
FEW = 32
#: Rows of surviving chunks up to which one task reads them all: then no shuffle and no second stage is needed.
ONE_TASK_ROWS = 500_000


@contextmanager
def scanning(spark: SparkSession, compiled: bool):
    """compiled=False turns code generation and the vectorised reader off; answers stay the same."""
    names = ("spark.sql.codegen.wholeStage", "spark.sql.parquet.enableVectorizedReader")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, before[n] if compiled else "false")
        yield
    finally:
        for n in names:
            spark.conf.set(n, before[n])


def bars_of(spark: SparkSession, root: str, plan: Plan) -> DataFrame:
    """The bars of the surviving chunks: a partition filter, so other files are never listed into the scan."""
    table = Table(root, plan.query.table)
    ids = [int(c["chunk_id"]) for c in plan.candidates]
    if len(ids) <= FEW:  # no need to list the folders of the others
        reader = spark.read.schema(_STORED).option("basePath", table.chunks)
        bars = reader.parquet(*(c["path"] for c in plan.candidates)) if ids else spark.createDataFrame([], _STORED)
        return bars.coalesce(1) if sum(c["row_count"] for c in plan.candidates) <= ONE_TASK_ROWS else bars
    bars = spark.read.schema(_STORED).parquet(table.chunks)
    if len(ids) == plan.total_chunks:
        return bars
    runs = runs_of(sorted(ids))
    if len(runs) <= MOST_NAMED:
        return bars.where(F.expr(" OR ".join(f"chunk_id BETWEEN {a} AND {b}" if a < b else f"chunk_id = {a}" for a, b in runs)))
    return bars.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "chunk_id long")), "chunk_id", "left_semi")


def runs_of(ids: list[int]) -> list[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    starts = [i for i, x in enumerate(ids) if not i or ids[i - 1] + 1 < x]
    return [(ids[a], ids[b - 1]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=False)]


def frame(spark: SparkSession, root: str, plan: Plan, exact: bool = False, matched: bool = False, whole: str = "long") -> DataFrame:
    return run(bars_of(spark, root, plan), plan.query, exact, matched, whole)


def collected(spark: SparkSession, root: str, plan: Plan, exact: bool) -> list[dict]:
    """The result's rows, one per group, with the number of matched rows.

    Sums of whole numbers are 64-bit, and are added again as decimals only if one does not fit.
    """
    query = plan.query
    found = [r.asDict() for r in frame(spark, root, plan, exact, matched=True, whole="try").collect()]
    sums = [a.key for a in query.aggregations if a.function == "sum" and a.column in WHOLE]
    if any(r[k] is None for r in found for k in sums):
        found = [r.asDict() for r in frame(spark, root, plan, exact, matched=True, whole="decimal").collect()]
        found = [r | {k: int(r[k]) for k in sums} for r in found]
    return found


def execute_plan(spark: SparkSession, root: str, plan: Plan, compiled: bool = True, exact: bool = False) -> Result:
    query = plan.query
    with scanning(spark, compiled):
        found = collected(spark, root, plan, exact)
    matched = sum(r.pop(MATCHED) for r in found)
    work = work_of(spark, root, plan)
    pushed = compiled and work["scanned_blocks"] > 0 and pushdown(query) is not None
    metrics = Metrics(
        total_chunks=plan.total_chunks, scanned_chunks=len(plan.candidates), total_blocks=work["total_blocks"], scanned_blocks=work["scanned_blocks"], rows_available=plan.total_rows,
        rows_scanned=work["rows_scanned"], rows_matched=matched, columns_read=plan.required_columns, native_filter_used=pushed, native_rows_evaluated=work["rows_scanned"] if pushed else 0,
    )
    return Result(query, found, metrics)


def execute(spark: SparkSession, root: str, query: Query, compiled: bool = True, exact: bool = False) -> Result:
    """Plan and run a query: its rows and what they cost to find."""
    return execute_plan(spark, root, make_plan(spark, root, query), compiled, exact)
