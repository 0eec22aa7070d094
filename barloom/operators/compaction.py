"""From the log to sorted, chunked Parquet with statistics. The manifest is written last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.layout import number_rows, with_chunks
from barloom.operators.zonemap import BLOCK_TABLE, block_statistics, chunk_statistics, chunks_of_blocks
from barloom.schema import BLOCK_ROWS, CHUNK_ROWS, COLUMNS, LAYOUTS
from barloom.sources import store
from barloom.sources.log import read_log
from barloom.sources.store import Table

#: Chunks that share a writing task's partition; each still gets its own file.
CHUNKS_PER_TASK = 16


@dataclass(frozen=True)
class Compaction:
    table: str
    layout: str
    rows_compacted: int
    chunk_count: int
    manifest_path: str


def compact(spark: SparkSession, root: str, name: str, chunk_rows: int = CHUNK_ROWS, layout: str = "time", block_rows: int = BLOCK_ROWS, block_index: bool = True) -> Compaction:
    """Sort the whole log into chunks of ``chunk_rows``, each one file whose row groups are blocks.

    A table is compacted once; the log stays. Checks come in this order:
    sizes and layout (ValueError), description, log and its rows' presence
    (FileNotFoundError), earlier output (FileExistsError), an empty log (ValueError).
    """
    if chunk_rows <= 0 or block_rows <= 0:
        raise ValueError("chunks and blocks need a positive number of rows")
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    table = Table(root, name)
    for path in (table.description, table.log):
        if not store.exists(spark, path):
            raise FileNotFoundError(path)
    if not any(n.startswith("_batch=") for n in store.names(spark, table.log)):
        raise FileNotFoundError(f"{table.log} has no ingest")
    if store.exists(spark, table.manifest):
        raise FileExistsError(table.manifest)
    if store.names(spark, table.chunks):
        raise FileExistsError(table.chunks)
    logged = store.staged(read_log(spark, table), "log")[0]  # the log's text is parsed once
    numbered = number_rows(logged, layout)
    total = numbered.count()
    if not total:
        raise ValueError(f"the log of {name} has no rows")
    placed = with_chunks(numbered.select(*COLUMNS, "rn"), chunk_rows, block_rows)
    chunk_count = -(-total // chunk_rows)
    write_chunks(placed, table.chunks, chunk_count, block_rows)
    chunks = chunk_statistics(placed)
    if block_index:
        block_statistics(placed).coalesce(max(1, chunk_count // 1000)).write.parquet(table.block_statistics)
        chunks = chunks_of_blocks(spark.read.schema(BLOCK_TABLE).parquet(table.block_statistics))
    chunks.coalesce(max(1, chunk_count // 10_000)).write.parquet(table.chunk_statistics)
    for copy in (numbered, logged):
        store.discard(copy)
    store.write_json(spark, table.manifest, {"table": name, "layout": layout, "chunk_size": chunk_rows, "block_size_rows": block_rows, "chunk_count": chunk_count, "total_rows": total, "block_index": block_index})
    return Compaction(name, layout, total, chunk_count, table.manifest)


def write_chunks(placed: DataFrame, path: str, chunk_count: int, block_rows: int) -> None:
    """One file per chunk in its own folder; a Parquet row group is a block, so Spark skips blocks by their statistics."""
    tasks = max(1, min(chunk_count, -(-chunk_count // CHUNKS_PER_TASK) if chunk_count > 2000 else chunk_count))
    rows = placed.repartition(tasks, "chunk_id").sortWithinPartitions("chunk_id", "rn").drop("block_id")
    rows.write.partitionBy("chunk_id").option("parquet.block.row.count.limit", block_rows).option("parquet.page.row.count.limit", min(block_rows, 20_000)).parquet(path)
