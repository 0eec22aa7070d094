"""The append-only log of a table: CSV or frames in, rows in ingest order out."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import BAR, COLUMNS
from barloom.sources import store
from barloom.sources.store import Table

#: Place of a row in the log: the ingest it came with, and its order there.
ORDER = ("_batch", "_row")
LOGGED = T.StructType([*BAR.fields, T.StructField("_batch", T.LongType()), T.StructField("_row", T.LongType())])


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bars of CSV files with exactly the schema's header.

    All fields are read as text and cast strictly: blanks around numbers, nan
    and inf pass, anything else raises. An empty symbol is kept, an empty number
    raises. multi_line allows quoted line breaks, at the price of unsplit files.
    """
    head = spark.read.text(path).head(1)
    header = next(csv.reader([head[0][0]])) if head else []
    if header != COLUMNS:
        raise ValueError(f"the header must be {','.join(COLUMNS)}; it is {','.join(header)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    rows = spark.read.csv(path, schema=text, header=True, enforceSchema=False, mode="FAILFAST", escape='"', multiLine=multi_line)

    def typed(f: T.StructField):
        c = F.col(f.name)
        if f.name == "symbol":
            return F.coalesce(c, F.lit("")).alias(f.name)
        return F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} is empty"))).otherwise(c.cast(f.dataType)).alias(f.name)

    return rows.select(*map(typed, BAR.fields))


def append(spark: SparkSession, table: Table, bars: DataFrame) -> int:
    """Append bars as one more ingest; the rows written. An ingest is written whole or not at all."""
    store.make_folder(spark, table.log)
    if not store.exists(spark, table.description):
        store.write_json(spark, table.description, {"table": table.name, "columns": [{"name": f.name, "type": f.dataType.typeName()} for f in BAR.fields]})
    batch = 1 + max((int(n.partition("=")[2]) for n in store.names(spark, table.log) if n.startswith("_batch=")), default=0)
    folder = f"{table.log}/_batch={batch}"
    bars.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()).write.json(folder)
    return spark.read.schema(LOGGED).json(folder).count()


def ingest_csv(spark: SparkSession, root: str, name: str, path: str, multi_line: bool = False) -> tuple[int, str]:
    """Append a CSV file to a table's log: (rows written, log folder). The header is checked first."""
    table = Table(root, name)
    return append(spark, table, read_csv(spark, path, multi_line)), table.log


def read_log(spark: SparkSession, table: Table) -> DataFrame:
    """All logged rows with their place; a field that doesn't fit its type raises."""
    return spark.read.schema(LOGGED).option("mode", "FAILFAST").json(table.log)
