"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

three after one warm-up, planning included, as published): with blocks of 1,024
rows, with blocks of whole chunks (``_coarse``) and without code generation
(``_interpreted``), which the total leaves out; and aggregates over the bars of $BENCH_SF_DIR. Making and compacting the bars is not timed.
"""

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))


def timed(f, runs: int = 3) -> float:
    f()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return statistics.median(took)


def main() -> None:
    from pyspark.sql import SparkSession

    from barloom.cases import SYMBOLS, block_cases, layout_cases, scan_cases
    from barloom.operators.compaction import compact
    from barloom.operators.execution import execute
    from barloom.operators.scan import run
    from barloom.plans.tokens import query_of
    from barloom.schema import CHUNK_ROWS, LAYOUTS
    from barloom.sources import generator
    from barloom.sources.bars import from_events, from_lineitem
    from barloom.sources.log import ingest_csv

    with tempfile.TemporaryDirectory() as home:
        spark = (
            SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{home}/shared").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        generator.write_csv(f"{home}/bars.csv", SYMBOLS, ROWS)
        first, last = generator.START, generator.START + (ROWS - 1) * generator.STEP
        took = {}
        for layout in LAYOUTS:
            ingest_csv(spark, home, layout, f"{home}/bars.csv")
            began = time.perf_counter()
            compact(spark, home, layout, layout=layout)
            took[f"compact_{layout}"] = time.perf_counter() - began
            ingest_csv(spark, home, f"{layout}_coarse", f"{home}/bars.csv")
            compact(spark, home, f"{layout}_coarse", layout=layout, block_rows=CHUNK_ROWS)
        for layout in LAYOUTS:
            for case in {c.name: c for c in [*layout_cases(first, last), *block_cases(first, last), *scan_cases(first, last)]}.values():
                q = query_of(layout, case.aggregations, case.filters)
                took[f"{case.name}_{layout}"] = timed(lambda q=q: execute(spark, home, q))
            for case in [*layout_cases(first, last), *block_cases(first, last)]:  # blocks of a whole chunk
                q = query_of(f"{layout}_coarse", case.aggregations, case.filters)
                took[f"{case.name}_{layout}_coarse"] = timed(lambda q=q: execute(spark, home, q))
            for case in scan_cases(first, last):  # without code generation and vectorised reading
                q = query_of(layout, case.aggregations, case.filters)
                took[f"{case.name}_{layout}_interpreted"] = timed(lambda q=q: execute(spark, home, q, compiled=False))
        whole = query_of("bars", ["count", "sum:volume", "avg:close", "min:low", "max:high"], [], ["symbol"])
        took["bars_of_lineitem"] = timed(lambda: run(from_lineitem(spark, SF), whole).collect())
        took["bars_of_events"] = timed(lambda: run(from_events(spark, SF), whole).collect())
        spark.stop()
    headline = sum(v for k, v in took.items() if not k.endswith(("_coarse", "_interpreted")))
    print(json.dumps({"metric": "total_seconds", "value": round(headline, 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in took.items()}, "sf": os.path.basename(SF.rstrip("/")), "rows": ROWS, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
