"""Files of a table, reached through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds."""
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_json(spark: SparkSession, path: str, content: Any) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray((json.dumps(content, indent=2) + "\n").encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> Any:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors can both write: the checkpoint folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "/tmp/checkpoints/barloom").rstrip("/")


_staged: list[str] = []


def staged(df: DataFrame, what: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """df written once and read back, and where: what follows sees the same rows on every retry."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(df: DataFrame) -> None:
    """Delete the staged copies that df is read from."""
    files = df.inputFiles()
    for path in [p for p in _staged if any(p.rpartition("/")[2] in f for f in files)]:
        _staged.remove(path)
        remove(df.sparkSession, path)


@dataclass(frozen=True)
class Table:
    """The folders of one table. The manifest is written last: with it the table can be queried."""

    root: str
    name: str

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.name):
            raise ValueError(f"{self.name!r} is no table name")

    @property
    def home(self) -> str:
        return f"{str(self.root).rstrip('/')}/{self.name}"

    description = property(lambda self: f"{self.home}/table.json")
    log = property(lambda self: f"{self.home}/log")
    chunks = property(lambda self: f"{self.home}/chunks")
    chunk_statistics = property(lambda self: f"{self.home}/chunk_statistics")
    block_statistics = property(lambda self: f"{self.home}/block_statistics")
    manifest = property(lambda self: f"{self.home}/manifest.json")
