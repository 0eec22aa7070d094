"""Command line: generate, ingest, compact, query-plan, query, demo."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from barloom.operators.compaction import compact
from barloom.operators.execution import execute
from barloom.plans.planner import explain, plan
from barloom.plans.tokens import query_of
from barloom.schema import BLOCK_ROWS, CHUNK_ROWS, LAYOUTS
from barloom.sources import generator
from barloom.sources.log import ingest_csv

ROOT = ".barloom"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barloom", description="Market bars on Spark: ingest, compact, query.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, table: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        if table:
            p.add_argument("--table", required=True)
            p.add_argument("--root", default=ROOT)
        return p

    p = command("generate", "write synthetic bars to a CSV file", table=False)
    p.add_argument("--symbols", required=True, help="comma-separated")
    p.add_argument("--rows", type=int, required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--start-ts", type=int, default=generator.START)
    p.add_argument("--step-seconds", type=int, default=generator.STEP)
    p.add_argument("--seed", type=int, default=generator.SEED)
    p = command("ingest", "append a CSV file to a table's log")
    p.add_argument("--file", required=True)
    p = command("compact", "sort the log into chunks")
    p.add_argument("--chunk-size", type=int, default=CHUNK_ROWS)
    p.add_argument("--block-size-rows", type=int, default=BLOCK_ROWS)
    p.add_argument("--layout", choices=list(LAYOUTS), default="time")
    for name, text in (("query-plan", "show which chunks a query would read"), ("query", "run a query")):
        p = command(name, text)
        p.add_argument("--agg", action="append", required=True, help="count, or like avg:close")
        p.add_argument("--filter", action="append", default=[], help="like symbol=AAPL or close>100")
        p.add_argument("--group-by", action="append", default=[], help="symbol")
        if name == "query":
            p.add_argument("--disable-native-scan", action="store_true", help="without code generation and vectorised reading")
        else:
            p.add_argument("--physical", action="store_true", help="Spark's physical plan instead")
    p = command("demo", "both layouts side by side", table=False)
    p.add_argument("--root", default=ROOT)
    p.add_argument("--rows", type=int, default=100_000)
    return top


def demo(spark: SparkSession, root: str, rows: int) -> list[dict]:
    """One query over the same bars in both layouts: answer and scan work."""
    out = []
    path = f"{root}/demo.csv"
    import os

    os.makedirs(root, exist_ok=True)
    generator.write_csv(path, ["AAPL", "MSFT", "NVDA", "AMZN", "GOOG", "META", "TSLA", "AMD", "AVGO", "SPY"], rows)
    for layout in LAYOUTS:
        name = f"demo_{layout}"
        ingest_csv(spark, root, name, path)
        compact(spark, root, name, layout=layout)
        out.append({"layout": layout} | execute(spark, root, query_of(name, ["sum:volume"], ["symbol=NVDA", "close>150"])).as_dict())
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well; 1 with a message if not."""
    a = parser().parse_args(argv)
    try:
        if a.command == "generate":
            n = generator.write_csv(a.output, [s.strip() for s in a.symbols.split(",") if s.strip()], a.rows, a.start_ts, a.step_seconds, a.seed)
            print(f"generated {n} rows at {a.output}")
            return 0
        spark = spark or SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "ingest":
            n, log = ingest_csv(spark, a.root, a.table, a.file)
            print(f"ingested {n} rows into {log}")
        elif a.command == "compact":
            c = compact(spark, a.root, a.table, a.chunk_size, a.layout, a.block_size_rows)
            print(f"compacted {c.rows_compacted} rows into {c.chunk_count} chunks at {c.manifest_path}")
        elif a.command == "demo":
            print(json.dumps(demo(spark, a.root, a.rows), indent=2))
        else:
            query = query_of(a.table, a.agg, a.filter, a.group_by)
            if a.command == "query":
                print(json.dumps(execute(spark, a.root, query, compiled=not a.disable_native_scan).as_dict(), indent=2))
            else:
                print(explain(spark, a.root, query) if a.physical else json.dumps(plan(spark, a.root, query).as_dict(), indent=2))
        return 0
    except Exception as e:  # noqa: BLE001 - the message is for a person
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
