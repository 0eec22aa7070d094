"""Shared pieces of the training-data operators.

Null handling common to all text operators: a null text counts as an empty
one; ids are passed through unread, so null and repeated ids are kept row for
row. Operators read the columns they name and return only their own result
columns; those that return whole rows pack them into one struct first. So
further columns of any name never clash.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch handed to Python, so that very long texts do not add up.
BATCH_BYTES = 4 << 20
#: ASCII white space, the separators of words throughout the package.
WHITE = b" \t\n\x0b\x0c\r"
#: A word in Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches bounded in bytes."""
    spark = df.sparkSession
    bound_batches(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where none is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/barloom"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, what: str, columns: int = 0) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here.

    The files are deleted when the application ends (or by ``release``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str | None = None) -> None:
    """Delete what ``stored`` has written (all of it, or one path)."""
    for item in list(_written):
        if path is None or item[1] == path:
            _written.remove(item)
            try:
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(item[1])
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary
                pass


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``stored`` gave."""
    for name in df.inputFiles()[:1]:
        for _, path in list(_written):
            if path.rpartition("/")[2] in name:
                release(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        if spark.sparkContext._jsc is not None:
            release(spark, path)


def packed(docs: DataFrame) -> DataFrame:
    """Each row of docs as one struct, ``row``: helper columns beside it clash with no column of docs."""
    return docs.select(F.struct("*").alias("row"))


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, df.schema[name].dataType, True)


_at_end: list[Callable[[], None]] = []


def at_partition_end(fn: Callable[[], None]) -> Callable[[], None]:
    """Call fn in a worker whenever a partition ends: workers are reused, what they remember must not add up."""
    _at_end.append(fn)
    return fn


def give_back() -> None:
    """Forget what this worker remembers, and return free memory to the system."""
    for fn in _at_end:
        fn()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def per_partition(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that gives its memory back at the end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, at least a row each."""
    n = max(1, min(batch.num_rows, -(-batch.nbytes // most)))
    step = -(-batch.num_rows // n)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def arrow_map(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: T.StructType,
    most: int = BATCH_BYTES,
) -> DataFrame:
    """mapInArrow with one result batch (or none) per input batch, or per slice of about ``most`` bytes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, most) if batch.num_rows else ():
                if (out := fn(part)) is not None:
                    yield out

    session(df)
    return df.mapInArrow(per_partition(run), schema)


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch of the types that Spark expects."""
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BinaryType: pa.binary()}
    arrays = []
    for f, c in zip(schema.fields, columns, strict=True):
        if isinstance(c, (pa.Array, pa.ChunkedArray)):
            arrays.append(c)
        elif isinstance(f.dataType, T.ArrayType):
            arrays.append(pa.array(c, pa.list_(kinds[type(f.dataType.elementType)])))
        else:
            arrays.append(pa.array(c, kinds[type(f.dataType)]))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def texts(batch: pa.RecordBatch, i: int = 1) -> list[str]:
    """The texts of a column, null as empty."""
    return [t or "" for t in batch.column(i).to_pylist()]


def held_out(id_col: str) -> F.Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
