"""The engine's operators as driver queries, each with its twin in SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.cases import block_cases, layout_cases, scan_cases
from barloom.functions.predicates import run_may_match
from barloom.operators import encodings
from barloom.operators.compaction import compact
from barloom.operators.execution import execute_plan, frame, scanning
from barloom.operators.layout import number_rows, with_chunks
from barloom.operators.scan import matching, required_columns, run
from barloom.operators.zonemap import block_statistics, chunk_statistics
from barloom.plans.planner import plan, pushdown, scan_work, surviving
from barloom.plans.spec import Query
from barloom.plans.tokens import query_of
from barloom.schema import COLUMNS, LAYOUTS, NUMERIC
from barloom.sources import generator, store
from barloom.sources.bars import from_events, from_lineitem
from barloom.sources.log import append, read_csv, read_log
from barloom.sources.store import Table

CHUNK, BLOCK = 500, 128
Run = Callable[[SparkSession, str], DataFrame]

_EV = """ev AS (
  SELECT event_type AS symbol, cast(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS "timestamp",
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         sum(cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS volume
  FROM events GROUP BY 1, 2)"""
_LI = """li AS (
  SELECT l_returnflag || l_linestatus AS symbol, cast(floor(epoch(l_shipdate)) AS BIGINT) AS "timestamp",
         l_extendedprice AS open, l_extendedprice + l_quantity AS high, l_extendedprice - l_quantity AS low,
         l_extendedprice AS close, l_quantity::BIGINT AS volume FROM lineitem)"""


def _placed_sql(layout: str) -> str:
    keys = ", ".join(f'"{k}"' for k in LAYOUTS[layout])
    return f"""WITH {_EV}, n AS (SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS rn FROM ev),
placed AS (SELECT *, rn // {CHUNK} AS chunk_id, (rn % {CHUNK}) // {BLOCK} AS block_id FROM n)"""


_ENDS_SQL = ", ".join(f'{f}("{c}") AS {c}_{f}' for c in NUMERIC for f in ("min", "max"))
_STATS_SQL = f"count(*)::BIGINT AS row_count, list_sort(list(DISTINCT symbol)) AS symbols, {_ENDS_SQL}"


def _aggregate_sql(query: Query) -> str:
    parts = []
    for a in query.aggregations:
        c = f'"{a.column}"'
        if a.function == "count":
            e = "count(*)"
        elif a.function in ("min", "max"):
            e = f"{a.function}({c})"
        elif a.column in ("timestamp", "volume"):
            e = f"coalesce(sum({c}), 0)::BIGINT" if a.function == "sum" else f"cast(sum({c}::DECIMAL(38, 0)) AS DOUBLE) / count({c})"
        else:
            total = f"cast(sum(cast({c} AS DECIMAL(18, 4))) AS DOUBLE)"
            e = f"coalesce({total}, 0.0)" if a.function == "sum" else f"{total} / count({c})"
        parts.append(f"{e} AS {a.key}")
    return ", ".join(parts)


def _where_sql(query: Query) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return " AND ".join(f'"{f.column}" {f.operator} {value(f.value)}' for f in query.filters) or "TRUE"


def _runs_sql(query: Query) -> str:
    parts = []
    for f in query.filters:
        lo, hi = f"{f.column}_min", f"{f.column}_max"
        parts.append(f"list_contains(symbols, '{f.value}')" if f.column == "symbol" else f"{lo} <= {f.value!r} AND {hi} >= {f.value!r}" if f.operator == "=" else f"{hi if f.operator[0] == '>' else lo} {f.operator} {f.value!r}")
    return " AND ".join(f"({p})" for p in parts) or "TRUE"


def _sql_of(query: Query, view: str = "ev") -> str:
    groups = ", ".join(query.group_by)
    return f"WITH {_EV if view == 'ev' else _LI} SELECT {groups + ', ' if groups else ''}{_aggregate_sql(query)} FROM {view} WHERE {_where_sql(query)}{' GROUP BY ' + groups + ' ORDER BY ' + groups if groups else ''}"


#: name -> (aggregates, filters, groups), over hourly bars of events.
TOKENS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "filter_symbol_eq": (["count", "sum:volume"], ["symbol=click"], []),
    "filter_num_eq": (["count", "sum:volume"], ["volume=50"], []),
    "filter_gt": (["count", "sum:close"], ["close>50"], []),
    "filter_ge": (["count", "min:low"], ["low>=1.5"], []),
    "filter_lt": (["count", "max:high"], ["high<80.25"], []),
    "filter_le": (["count", "avg:open"], ["open<=42"], []),
    "filter_conjunction": (["count", "sum:volume", "avg:close"], ["symbol=click", "close>50", "volume>=20", "low<90"], []),
    "filter_range_closed": (["count", "sum:volume"], ["volume>=40", "volume<=120"], []),
    "filter_range_open": (["count", "sum:volume"], ["close>10", "close<60"], []),
    "agg_count": (["count"], [], []),
    "agg_sum_int": (["sum:volume", "sum:timestamp"], [], []),
    "agg_sum_float": (["sum:close", "sum:open"], [], []),
    "agg_avg_float": (["avg:close", "avg:high"], [], []),
    "agg_avg_int": (["avg:volume", "avg:timestamp"], [], []),
    "agg_min": ([f"min:{c}" for c in NUMERIC], [], []),
    "agg_max": ([f"max:{c}" for c in NUMERIC], [], []),
    "agg_multi": (["count", "sum:volume", "avg:close", "min:low", "max:high"], ["close>20"], []),
    "agg_empty_input": (["count", "sum:volume", "sum:close", "avg:close", "avg:volume", "min:low", "max:high"], ["symbol=none"], []),
    "group_by_symbol": (["count", "sum:volume", "avg:close", "min:timestamp", "max:high"], [], ["symbol"]),
    "group_by_filtered": (["count", "sum:close"], ["close>50", "volume>20"], ["symbol"]),
    "group_by_empty": (["count", "sum:volume"], ["close<-1"], ["symbol"]),
    "flagship": (["sum:volume", "count"], ["symbol=click", "close>50"], []),
}

#: Filters whose pruning is compared, with their aggregate.
PRUNED = {"threshold": ["symbol=click", "close>90"], "price": ["close>99"], "volume_eq": ["volume=50"], "low": ["low<=0.5"], "conjunction": ["symbol=view", "volume>=100", "low<5"]}

#: Volumes of this size leave 64 bits when two are added.
HUGE = 1 << 62
#: Filters whose choice of a pushed column is compared, and that choice.
BOUNDS = {"none": ["symbol=click"], "equal": ["close>1", "close=3", "volume>2"], "first": ["volume>2", "close>1", "close<9"], "tight": ["low>=2", "low>2", "low<=8", "low<9"], "strict": ["low<8", "low<=8"]}
_CHOSEN = "('none', NULL, NULL, NULL, NULL, NULL), ('equal', 'close', 3, 3, true, true), ('first', 'volume', 2, NULL, false, true), ('tight', 'low', 2, 8, false, true), ('strict', 'low', NULL, 8, true, false)"

_built: dict[tuple, tuple[str, str]] = {}


def compacted(spark: SparkSession, sf_dir: str, layout: str) -> tuple[str, str]:
    """(root, table) of the events' bars, compacted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _built:
        root, name = f"{store.shared_folder(spark)}/bars-{abs(hash(key)):x}", f"ev_{layout}"
        if store.exists(spark, root):
            store.remove(spark, root)
        append(spark, Table(root, name), from_events(spark, sf_dir))
        compact(spark, root, name, CHUNK, layout, BLOCK)
        _built[key] = root, name
    return _built[key]


def _placed(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    return with_chunks(number_rows(from_events(spark, sf_dir), layout), CHUNK, BLOCK)


def _over(kind: str, tokens: tuple) -> Run:
    return lambda spark, sf_dir: run((from_events if kind == "ev" else from_lineitem)(spark, sf_dir), query_of("bars", *tokens), exact=True)


def _ingested(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    """Bars written as CSV, ingested ``times`` times, read back from the log."""
    folder = f"{store.shared_folder(spark)}/ingest-{abs(hash((spark.sparkContext.applicationId, sf_dir, times))):x}"
    if store.exists(spark, folder):
        store.remove(spark, folder)
    from_events(spark, sf_dir).select(*COLUMNS).coalesce(1).write.option("header", True).csv(f"{folder}/csv")
    for _ in range(times):
        append(spark, Table(folder, "bars"), read_csv(spark, f"{folder}/csv"))
    return read_log(spark, Table(folder, "bars")).select(*COLUMNS)


def _cases() -> dict[str, list[str]]:
    """Fixed windows of the cases, within the span of the events."""
    first, last = 1704067200, 1706659200
    several = itertools.chain(layout_cases(first, last, "click"), block_cases(first, last, "click"), scan_cases(first, last, "click", 50))
    return {c.name: (c.aggregations, c.filters) for c in several}


def _metrics(layout: str, aggregates: list[str], filters: list[str]) -> Run:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, layout)
        m = execute_plan(spark, root, plan(spark, root, query_of(name, aggregates, filters))).metrics
        fields = ("total_chunks", "scanned_chunks", "total_blocks", "scanned_blocks", "rows_available", "rows_scanned", "rows_matched")
        return spark.createDataFrame([tuple(getattr(m, f) for f in fields)], ", ".join(f"{f} long" for f in fields))

    return query


def _metrics_sql(layout: str, aggregates: list[str], filters: list[str]) -> str:
    q = query_of("bars", aggregates, filters)
    return f"""{_placed_sql(layout)},
c AS (SELECT chunk_id, {_STATS_SQL} FROM placed GROUP BY chunk_id),
b AS (SELECT chunk_id, block_id, {_STATS_SQL} FROM placed GROUP BY chunk_id, block_id),
kept AS (SELECT chunk_id FROM c WHERE {_runs_sql(q)}),
kb AS (SELECT * FROM b WHERE chunk_id IN (SELECT chunk_id FROM kept))
SELECT (SELECT count(*) FROM c)::BIGINT AS total_chunks, (SELECT count(*) FROM kept)::BIGINT AS scanned_chunks,
       (SELECT count(*) FROM kb)::BIGINT AS total_blocks, (SELECT count(*) FROM kb WHERE {_runs_sql(q)})::BIGINT AS scanned_blocks,
       (SELECT count(*) FROM placed)::BIGINT AS rows_available,
       (SELECT coalesce(sum(row_count), 0) FROM kb WHERE {_runs_sql(q)})::BIGINT AS rows_scanned,
       (SELECT count(*) FROM placed WHERE {_where_sql(q)})::BIGINT AS rows_matched"""


def _pruned_chunks(filters: list[str]) -> Run:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "symbol_time")
        return surviving(spark.read.parquet(Table(root, name).chunk_statistics), query_of(name, ["count"], filters)).select("chunk_id", "row_count")

    return query


def _pruned_chunks_sql(filters: list[str]) -> str:
    return f"{_placed_sql('symbol_time')}, c AS (SELECT chunk_id, {_STATS_SQL} FROM placed GROUP BY chunk_id) SELECT chunk_id, row_count FROM c WHERE {_runs_sql(query_of('t', ['count'], filters))}"


def block_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, name = compacted(spark, sf_dir, "symbol_time")
    q, t = query_of(name, ["count"], PRUNED["threshold"]), Table(root, name)
    chunks = surviving(spark.read.parquet(t.chunk_statistics), q).select("chunk_id")
    blocks = spark.read.parquet(t.block_statistics).join(chunks, "chunk_id", "left_semi")
    return blocks.where(run_may_match(q.filters)).select("chunk_id", "block_id", "row_start", "row_count")


def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, name = compacted(spark, sf_dir, "symbol_time")
    p = plan(spark, root, query_of(name, ["avg:close"], PRUNED["threshold"]))
    columns = ",".join(p.required_columns)
    rows = [(c["chunk_id"], c["row_count"], columns, p.total_chunks, p.total_rows) for c in p.candidates]
    return spark.createDataFrame(rows, "chunk_id string, row_count long, required_columns string, total_chunks long, total_rows long")


def scan_query(compiled: bool) -> Run:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "symbol_time")
        q = query_of(name, ["sum:volume", "count"], PRUNED["threshold"])
        with scanning(spark, compiled):  # planned and run with the switch as set here
            found = frame(spark, root, plan(spark, root, q)).collect()
        return spark.createDataFrame(found, "sum_volume long, count long")

    return query


def queries() -> dict[str, Run]:
    out: dict[str, Run] = {k: _over("ev", t) for k, t in TOKENS.items()}
    out |= {f"li_{k}": _over("li", TOKENS[k]) for k in ("agg_count", "agg_multi", "group_by_symbol")}
    out["gen_bars"] = lambda spark, sf_dir: generator.spread(spark, ["AAPL", "MSFT", "NVDA"], 3000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    out["ingest_csv_roundtrip"] = lambda spark, sf_dir: _ingested(spark, sf_dir, 1)
    out["ingest_append_twice"] = lambda spark, sf_dir: _ingested(spark, sf_dir, 2).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")).orderBy("symbol")

    def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "time")
        return read_log(spark, Table(root, name)).select(*COLUMNS)

    out["wal_scan"] = log_scan

    def compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "time")
        return spark.read.parquet(Table(root, name).chunks).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("rows"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))

    out["compact_counts"] = compact_counts
    for layout in LAYOUTS:
        out[f"layout_{layout}_rows"] = lambda spark, sf_dir, layout=layout: number_rows(from_events(spark, sf_dir), layout).select("rn", *COLUMNS)
    out["chunk_zone_map"] = lambda spark, sf_dir: chunk_statistics(_placed(spark, sf_dir, "time"))
    out["block_zone_map"] = lambda spark, sf_dir: block_statistics(_placed(spark, sf_dir, "symbol_time"))
    out["dictionary_ids"] = lambda spark, sf_dir: encodings.dictionary_ids(_placed(spark, sf_dir, "time"))
    out["dictionary_roundtrip"] = lambda spark, sf_dir: encodings.dictionary_values(encodings.dictionary_ids(p := _placed(spark, sf_dir, "time")), encodings.dictionary(p))
    out["timestamp_offsets"] = lambda spark, sf_dir: encodings.offsets(_placed(spark, sf_dir, "symbol_time"))
    out["offset_roundtrip"] = lambda spark, sf_dir: encodings.from_offsets(encodings.offsets(_placed(spark, sf_dir, "symbol_time")))
    out["native_masks"] = lambda spark, sf_dir: from_events(spark, sf_dir).select("symbol", "timestamp", encodings.mask("close", low=50, include_low=False).alias("gt"), encodings.mask("volume", low=20).alias("ge"), encodings.mask("low", high=5, include_high=False).alias("lt"), encodings.mask("high", high=90).alias("le"), encodings.mask("volume", 20, 60, True, False).alias("between"))

    out["mask_between_double"] = lambda spark, sf_dir: from_events(spark, sf_dir).select("symbol", "timestamp", *[encodings.mask("close", 10.5, 60.25, a, b).alias(f"between_{int(a)}{int(b)}") for a in (True, False) for b in (True, False)])
    out["mask_compare_int64"] = lambda spark, sf_dir: from_events(spark, sf_dir).select("symbol", "timestamp", encodings.mask("volume", low=50, include_low=False).alias("gt"), encodings.mask("volume", low=50).alias("ge"), encodings.mask("volume", high=50, include_high=False).alias("lt"), encodings.mask("volume", high=50).alias("le"), encodings.mask("timestamp", 1704067200, 1705000000, False, True).alias("between"))
    out["plain_roundtrip"] = lambda spark, sf_dir: encodings.plain(_placed(spark, sf_dir, "time"), "close", "volume", "timestamp")
    out["sum_beyond_64_bits"] = lambda spark, sf_dir: run(from_events(spark, sf_dir).withColumn("volume", F.lit(HUGE) - F.col("volume")), query_of("bars", ["sum:volume", "count"], [], ["symbol"]), whole="decimal")

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Prices added as doubles, as queries do by default; the order of rows shows in the last digits only."""
        found = run(from_events(spark, sf_dir), query_of("bars", ["sum:close", "avg:close", "sum:low", "avg:high"], ["close>5"], ["symbol"]))
        return found.select("symbol", *[F.round(c, 6).alias(c) for c in found.columns[1:]])

    out["agg_float_default"] = rounded

    def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = [(k, pushdown(query_of("bars", ["count"], f))) for k, f in BOUNDS.items()]
        return spark.createDataFrame([(k, *((p.column, p.low and float(p.low), p.high and float(p.high), p.include_low, p.include_high) if p else (None,) * 5)) for k, p in found], "name string, on_column string, low double, high double, include_low boolean, include_high boolean")

    out["pushdown_choice"] = choices

    def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _placed(spark, sf_dir, "time")
        n = rows.count()
        return encodings.row_range(rows, n // 4, n // 2, n).select("rn", "symbol", "timestamp", "close")

    out["row_range_read"] = range_read

    def required(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "time")
        q = query_of(name, ["avg:close"], ["symbol=click", "volume>10"])
        assert required_columns(q) == ["symbol", "close", "volume"]
        return matching(spark.read.parquet(Table(root, name).chunks), q)

    out["scan_required_columns"] = required
    out |= {f"chunk_prune_{k}": _pruned_chunks(f) for k, f in PRUNED.items()}
    out["block_prune_threshold"] = block_prune
    out["query_plan_candidates"] = plan_candidates
    for name, (aggregates, filters) in _cases().items():
        for layout in LAYOUTS:
            out[f"scan_metrics_{name}_{layout}"] = _metrics(layout, aggregates, filters)
    out["scan_codegen_on"], out["scan_codegen_off"] = scan_query(True), scan_query(False)

    def work(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, name = compacted(spark, sf_dir, "time")
        return scan_work(spark, root, query_of(name, ["count"], PRUNED["conjunction"]))

    out["scan_work_conjunction"] = work
    return out


def oracle_sql() -> dict[str, str]:
    bars = ", ".join(f'"{c}"' for c in COLUMNS)
    out = {k: _sql_of(query_of("bars", *t)) for k, t in TOKENS.items()}
    out |= {f"li_{k}": _sql_of(query_of("bars", *TOKENS[k]), "li") for k in ("agg_count", "agg_multi", "group_by_symbol")}
    out["gen_bars"] = f"SELECT 3000::BIGINT AS n, 3::BIGINT AS symbols, {generator.START}::BIGINT AS first, {generator.START + 2999 * generator.STEP}::BIGINT AS last"
    out["ingest_csv_roundtrip"] = out["wal_scan"] = f"WITH {_EV} SELECT {bars} FROM ev"
    out["ingest_append_twice"] = f"WITH {_EV} SELECT symbol, (2 * count(*))::BIGINT AS n, (2 * sum(volume))::BIGINT AS volume FROM ev GROUP BY symbol ORDER BY symbol"
    out["compact_counts"] = f"{_placed_sql('time')} SELECT chunk_id, count(*)::BIGINT AS rows, min(rn) AS first_rn, max(rn) AS last_rn FROM placed GROUP BY chunk_id"
    for layout in LAYOUTS:
        out[f"layout_{layout}_rows"] = f"{_placed_sql(layout)} SELECT rn, {bars} FROM placed"
    out["chunk_zone_map"] = f"{_placed_sql('time')} SELECT chunk_id, {_STATS_SQL} FROM placed GROUP BY chunk_id"
    out["block_zone_map"] = f"{_placed_sql('symbol_time')} SELECT chunk_id, block_id, min(rn) - chunk_id * {CHUNK} AS row_start, {_STATS_SQL} FROM placed GROUP BY chunk_id, block_id"
    ids = f"{_placed_sql('time')}, f AS (SELECT *, min(rn) OVER (PARTITION BY chunk_id, symbol) AS first_rn FROM placed)"
    out["dictionary_ids"] = f"{ids} SELECT rn, chunk_id, (dense_rank() OVER (PARTITION BY chunk_id ORDER BY first_rn) - 1)::BIGINT AS id FROM f"
    out["dictionary_roundtrip"] = f'{_placed_sql("time")} SELECT rn, chunk_id, symbol AS "value" FROM placed'
    base = 'first_value("timestamp") OVER (PARTITION BY chunk_id ORDER BY rn)'
    out["timestamp_offsets"] = f'{_placed_sql("symbol_time")} SELECT rn, chunk_id, {base} AS base, "timestamp" - {base} AS "offset" FROM placed'
    out["offset_roundtrip"] = f'{_placed_sql("symbol_time")} SELECT rn, chunk_id, "timestamp" AS "value" FROM placed'
    out["native_masks"] = f'WITH {_EV} SELECT symbol, "timestamp", (close > 50)::INTEGER AS gt, (volume >= 20)::INTEGER AS ge, (low < 5)::INTEGER AS lt, (high <= 90)::INTEGER AS le, (volume >= 20 AND volume < 60)::INTEGER AS "between" FROM ev'
    sides = ", ".join(f"(close >{'=' * a} 10.5 AND close <{'=' * b} 60.25)::INTEGER AS between_{a}{b}" for a in (1, 0) for b in (1, 0))
    out["mask_between_double"] = f'WITH {_EV} SELECT symbol, "timestamp", {sides} FROM ev'
    out["mask_compare_int64"] = f'WITH {_EV} SELECT symbol, "timestamp", (volume > 50)::INTEGER AS gt, (volume >= 50)::INTEGER AS ge, (volume < 50)::INTEGER AS lt, (volume <= 50)::INTEGER AS le, ("timestamp" > 1704067200 AND "timestamp" <= 1705000000)::INTEGER AS "between" FROM ev'
    out["plain_roundtrip"] = f'{_placed_sql("time")} SELECT rn, chunk_id, close, volume, "timestamp" FROM placed'
    out["sum_beyond_64_bits"] = f"WITH {_EV} SELECT symbol, sum({HUGE}::HUGEINT - volume)::DECIMAL(38, 0) AS sum_volume, count(*)::BIGINT AS count FROM ev GROUP BY symbol"
    out["agg_float_default"] = f"WITH {_EV} SELECT symbol, round(sum(close), 6) AS sum_close, round(avg(close), 6) AS avg_close, round(sum(low), 6) AS sum_low, round(avg(high), 6) AS avg_high FROM ev WHERE close > 5 GROUP BY symbol"
    out["pushdown_choice"] = f"SELECT name, on_column, low::DOUBLE AS low, high::DOUBLE AS high, include_low, include_high FROM (VALUES {_CHOSEN}) AS t(name, on_column, low, high, include_low, include_high)"
    out["row_range_read"] = f'{_placed_sql("time")} SELECT rn, symbol, "timestamp", close FROM placed WHERE rn >= (SELECT count(*) // 4 FROM placed) AND rn < (SELECT count(*) // 2 FROM placed)'
    out["scan_required_columns"] = f"WITH {_EV} SELECT symbol, close, volume FROM ev WHERE symbol = 'click' AND volume > 10"
    out |= {f"chunk_prune_{k}": _pruned_chunks_sql(f) for k, f in PRUNED.items()}
    q = query_of("t", ["count"], PRUNED["threshold"])
    stats = f"{_placed_sql('symbol_time')}, c AS (SELECT chunk_id, {_STATS_SQL} FROM placed GROUP BY chunk_id), b AS (SELECT chunk_id, block_id, min(rn) - chunk_id * {CHUNK} AS row_start, {_STATS_SQL} FROM placed GROUP BY chunk_id, block_id)"
    out["block_prune_threshold"] = f"{stats} SELECT chunk_id, block_id, row_start, row_count FROM b WHERE {_runs_sql(q)} AND chunk_id IN (SELECT chunk_id FROM c WHERE {_runs_sql(q)})"
    out["query_plan_candidates"] = f"{stats} SELECT printf('%06d', chunk_id) AS chunk_id, row_count, 'symbol,close' AS required_columns, (SELECT count(*) FROM c)::BIGINT AS total_chunks, (SELECT count(*) FROM placed)::BIGINT AS total_rows FROM c WHERE {_runs_sql(q)}"
    for name, (aggregates, filters) in _cases().items():
        for layout in LAYOUTS:
            out[f"scan_metrics_{name}_{layout}"] = _metrics_sql(layout, aggregates, filters)
    out["scan_codegen_on"] = out["scan_codegen_off"] = f"WITH {_EV} SELECT sum(volume)::BIGINT AS sum_volume, count(*)::BIGINT AS count FROM ev WHERE {_where_sql(q)}"
    r = _runs_sql(query_of("t", ["count"], PRUNED["conjunction"]))
    out["scan_work_conjunction"] = stats.replace(_placed_sql("symbol_time"), _placed_sql("time")) + f", kb AS (SELECT * FROM b WHERE chunk_id IN (SELECT chunk_id FROM c WHERE {r})) SELECT count(*)::BIGINT AS total_blocks, (count(*) FILTER (WHERE {r}))::BIGINT AS scanned_blocks, coalesce(sum(row_count) FILTER (WHERE {r}), 0)::BIGINT AS rows_scanned FROM kb"
    return out
