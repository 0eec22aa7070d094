"""The bars engine: fixtures with known rows and scan work, invariants, errors."""

import csv
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.cases import block_cases, layout_cases, scan_cases, window
from barloom.cli import main
from barloom.functions.predicates import row_matches, run_may_match
from barloom.operators import encodings
from barloom.operators.compaction import compact
from barloom.operators.execution import execute, frame
from barloom.operators.layout import number_rows, with_chunks
from barloom.operators.scan import required_columns, run
from barloom.operators.zonemap import block_statistics, chunk_statistics
from barloom.plans.planner import explain, plan
from barloom.plans.spec import Aggregate, Filter
from barloom.plans.tokens import aggregate_of, filter_of, query_of
from barloom.schema import BAR, COLUMNS, LAYOUTS
from barloom.sources import generator, store
from barloom.sources.log import append, ingest_csv, read_log
from barloom.sources.store import Table
from barloom.streaming.log_stream import ingest_stream, windowed

SIX = [(s, t, p + d, p + d + 1 + d, p + d - 0.5, p + d + 0.5 + d, v + w) for s, p, v in (("AAPL", 10.0, 100), ("MSFT", 20.0, 200), ("NVDA", 30.0, 300)) for t, d, w in ((1000, 0, 0), (1010, 0.5, 20))]
SPIKE = [("AAPL", 1000 + 10 * i, p, p + 1, p - 0.5, p + 0.5, v) for i, (p, v) in enumerate([(10.0, 100), (10.5, 110), (50.0, 500), (50.5, 510), (12.0, 120), (12.5, 130)])]


def write(path, rows, header=COLUMNS):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def build(spark, tmp_path, rows, chunk, layout="symbol_time", block=1024, name="bars", **more):
    ingest_csv(spark, str(tmp_path), name, write(tmp_path / f"{name}.csv", rows))
    return compact(spark, str(tmp_path), name, chunk, layout, block, **more)


def metrics(result):
    m = result.metrics.as_dict()
    return tuple(m[k] for k in ("total_chunks", "skipped_chunks", "scanned_chunks", "total_blocks", "skipped_blocks", "scanned_blocks", "rows_available", "rows_scanned", "rows_matched"))


@pytest.mark.parametrize(
    "tokens, rows, work, columns",
    [
        ((["count"], [], []), [{"count": 6}], (3, 0, 3, 3, 0, 3, 6, 6, 6), []),
        ((["avg:close"], ["symbol=AAPL"], []), [{"avg_close": 11.0}], (3, 2, 1, 1, 0, 1, 6, 2, 2), ["symbol", "close"]),
        ((["sum:volume"], ["close>31"], []), [{"sum_volume": 320}], (3, 2, 1, 1, 0, 1, 6, 2, 1), ["close", "volume"]),
        ((["count"], [], ["symbol"]), [{"symbol": s, "count": 2} for s in ("AAPL", "MSFT", "NVDA")], (3, 0, 3, 3, 0, 3, 6, 6, 6), ["symbol"]),
    ],
)
def test_six_rows(spark, tmp_path, tokens, rows, work, columns):
    build(spark, tmp_path, SIX, 2)
    found = execute(spark, str(tmp_path), query_of("bars", *tokens))
    assert found.rows == rows and metrics(found) == work and found.metrics.columns_read == columns
    shape = found.as_dict()
    assert shape["result_row_count"] == len(rows) and shape["metrics"]["column_count"] == len(columns)


def test_plans_name_candidates(spark, tmp_path):
    build(spark, tmp_path, SIX, 2)
    p = plan(spark, str(tmp_path), query_of("bars", ["avg:close"], ["symbol=AAPL"])).as_dict()
    assert [c["chunk_id"] for c in p["candidate_chunks"]] == ["000000"] and p["required_columns"] == ["symbol", "close"]
    assert len(p["candidate_chunks"][0]) == 16 and p["selected_chunk_count"] == 1 and p["total_rows"] == 6
    p = plan(spark, str(tmp_path), query_of("bars", ["sum:volume"], ["close>25"])).as_dict()
    assert [c["chunk_id"] for c in p["candidate_chunks"]] == ["000002"]
    text = explain(spark, str(tmp_path), query_of("bars", ["sum:volume"], ["close>25"]))
    assert "GreaterThan(close,25.0)" in text and "ReadSchema: struct<close:double,volume:bigint>" in text


@pytest.mark.parametrize("compiled", [True, False])
def test_blocks_are_skipped(spark, tmp_path, compiled):
    build(spark, tmp_path, SPIKE, 6, block=2)
    found = execute(spark, str(tmp_path), query_of("bars", ["sum:volume"], ["symbol=AAPL", "close>40"]), compiled)
    assert found.rows == [{"sum_volume": 1010}] and metrics(found) == (1, 0, 1, 3, 2, 1, 6, 2, 2)
    assert found.metrics.as_dict()["block_pruning_rate"] == pytest.approx(2 / 3)
    assert (found.metrics.native_filter_used, found.metrics.native_rows_evaluated) == ((True, 2) if compiled else (False, 0))


def test_chunks_without_block_statistics_are_one_block(spark, tmp_path):
    build(spark, tmp_path, SPIKE, 3, block=2, block_index=False)
    found = execute(spark, str(tmp_path), query_of("bars", ["count"], ["close>40"]))
    assert found.rows == [{"count": 2}] and metrics(found) == (2, 0, 2, 2, 0, 2, 6, 6, 2)


def test_compaction_statistics(spark, tmp_path):
    rows = [(s, t, 1.0, 2.0, 0.5, c, v) for s, t, c, v in (("MSFT", 1010, 20.5, 220), ("AAPL", 1020, 11.5, 110), ("AAPL", 1000, 10.5, 100), ("MSFT", 1000, 19.5, 200))]
    c = build(spark, tmp_path, rows, 2)
    assert (c.rows_compacted, c.chunk_count) == (4, 2)
    t = Table(str(tmp_path), "bars")
    first = spark.read.parquet(t.chunk_statistics).orderBy("chunk_id").first()
    assert (first.symbols, first.timestamp_min, first.timestamp_max, first.close_min, first.close_max, first.volume_min, first.volume_max) == (["AAPL"], 1000, 1020, 10.5, 11.5, 100, 110)
    blocks = spark.read.parquet(t.block_statistics).orderBy("chunk_id", "block_id").collect()
    assert [(b.block_id, b.row_start, b.row_count) for b in blocks] == [(0, 0, 2), (0, 0, 2)]
    assert store.read_json(spark, t.manifest)["total_rows"] == 4


def test_ties_keep_ingest_order(spark, tmp_path):
    build(spark, tmp_path, [(s, t, i, i, i, i, i) for i, (s, t) in enumerate([("NVDA", 1000), ("AAPL", 1000), ("MSFT", 1000), ("AAPL", 1010), ("AAPL", 1000)])], 10, "time")
    rows = spark.read.parquet(Table(str(tmp_path), "bars").chunks).orderBy("rn").collect()
    assert [(r.symbol, r.timestamp, r.volume) for r in rows] == [("AAPL", 1000, 1), ("AAPL", 1000, 4), ("MSFT", 1000, 2), ("NVDA", 1000, 0), ("AAPL", 1010, 3)]


def test_two_blocks_in_a_chunk(spark, tmp_path):
    build(spark, tmp_path, SPIKE[:4], 10, block=2)
    blocks = spark.read.parquet(Table(str(tmp_path), "bars").block_statistics).orderBy("block_id").collect()
    assert [(b.block_id, b.row_start, b.row_count, b.close_min, b.close_max) for b in blocks] == [(0, 0, 2, 10.5, 11.0), (1, 2, 2, 50.5, 51.0)]


def test_row_groups_are_blocks(spark, tmp_path):
    import pyarrow.parquet as pq

    build(spark, tmp_path, [("A", i, 1.0, 1.0, 1.0, 1.0, i) for i in range(5000)], 2500, "time", 1000)
    for path in (tmp_path / "bars" / "chunks").rglob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]


GOLDEN = {
    "full_scan_count": {"count": 100000}, "time_window_avg_close": {"avg_close": 217.74240369999993}, "symbol_volume_sum": {"sum_volume": 25089844570}, "symbol_time_avg_close": {"avg_close": 180.13385340000013},
    "narrow_time_window_avg_close": {"avg_close": 218.38084300000003}, "narrow_symbol_time_avg_close": {"avg_close": 182.93623000000002}, "symbol_close_threshold_sum_volume": {"sum_volume": 15820298733},
}
#: (scanned chunks, total blocks, scanned blocks, rows scanned, rows matched) of 10 chunks in blocks of 1024.
WORK = {
    ("narrow_time_window_avg_close", "time"): (1, 10, 1, 1024, 100), ("narrow_time_window_avg_close", "symbol_time"): (10, 100, 10, 10240, 100), ("narrow_symbol_time_avg_close", "time"): (1, 10, 1, 1024, 10),
    ("narrow_symbol_time_avg_close", "symbol_time"): (1, 10, 1, 1024, 10), ("symbol_close_threshold_sum_volume", "time"): (10, 100, 100, 100000, 6324), ("symbol_close_threshold_sum_volume", "symbol_time"): (1, 10, 8, 8192, 6324),
}


def test_published_answers_and_scan_work(spark, tmp_path):
    from barloom.cases import SYMBOLS

    generator.write_csv(str(tmp_path / "walk.csv"), SYMBOLS, 100_000)
    first, last = generator.START, generator.START + 99_999 * generator.STEP
    for layout in LAYOUTS:
        ingest_csv(spark, str(tmp_path), layout, str(tmp_path / "walk.csv"))
        compact(spark, str(tmp_path), layout, layout=layout)
        for case in {c.name: c for c in [*layout_cases(first, last), *block_cases(first, last), *scan_cases(first, last)]}.values():
            found = execute(spark, str(tmp_path), query_of(layout, case.aggregations, case.filters))
            (key, value), (_, want) = *found.rows[0].items(), *GOLDEN[case.name].items()
            assert value == want if isinstance(want, int) else math.isclose(value, want, rel_tol=1e-9), (case.name, layout)
            if work := WORK.get((case.name, layout)):
                m = found.metrics
                assert (m.scanned_chunks, m.total_blocks, m.scanned_blocks, m.rows_scanned, m.rows_matched) == work, (case.name, layout)


def test_windows_and_cases():
    assert window(100, 200, 0.99, 0.5) == (199, 200) and window(5, 5, 0, 0) == (5, 5)
    assert [c.name for c in layout_cases(1000, 101000)] == ["full_scan_count", "time_window_avg_close", "symbol_volume_sum", "symbol_time_avg_close"]
    assert layout_cases(1000, 101000)[1].filters == ["timestamp>=46000", "timestamp<=47000"]
    assert [len(c.filters) for c in (*block_cases(1000, 101000), *scan_cases(1000, 101000))] == [2, 3, 2, 2]


def test_tokens():
    assert filter_of(" symbol=AAPL ") == Filter("symbol", "=", "AAPL") and filter_of("close>100.5") == Filter("close", ">", 100.5)
    assert filter_of("timestamp>= 1704067200") == Filter("timestamp", ">=", 1704067200) and filter_of("symbol==X") == Filter("symbol", "=", "=X")
    assert aggregate_of("count") == aggregate_of(" count:* ") == Aggregate("count") and aggregate_of("avg : close") == Aggregate("avg", "close")
    for wrong in ("close>", "close=>5", "symbol<=X", "price>1", "close >5", "volume>1.5", "close!=2", ""):
        with pytest.raises(ValueError):
            filter_of(wrong)
    for wrong in ("close", "median:close", "count:close", "sum:price", "sum:symbol"):
        with pytest.raises(ValueError):
            aggregate_of(wrong)
    for args in (([],), (["count", "count:*"],), (["count"], [], ["close"])):
        with pytest.raises(ValueError):
            query_of("t", *args)
    assert query_of("t", ["count"], [], ["symbol", " symbol"]).group_by == ["symbol"]
    assert required_columns(query_of("t", ["avg:close"], ["volume>1"], ["symbol"])) == ["symbol", "close", "volume"]


def test_empty_results_and_whole_numbers(spark):
    bars = spark.createDataFrame([("A", 1, 1.0, 1.0, 1.0, float("nan"), 2**62), ("A", 2, 1.0, 1.0, 1.0, 2.0, 2**62 - 1)], BAR)
    none = run(bars, query_of("t", ["count", "sum:volume", "sum:close", "avg:close", "avg:volume", "min:low", "max:high"], ["symbol=none"])).first()
    assert tuple(none) == (0, 0, 0.0, None, None, None, None)
    assert run(bars, query_of("t", ["avg:volume"])).first()[0] == (2**63 - 1) / 2
    assert [run(bars, query_of("t", ["count"], [f])).first()[0] for f in ("close>1", "close<3", "volume<9223372036854775808", "close=1")] == [1, 1, 2, 0]
    assert run(bars, query_of("t", ["count"], ["close=1", "close=2"])).first()[0] == 0
    assert run(bars, query_of("t", ["count"], ["symbol=none"], ["symbol"])).count() == 0


def test_pruning_never_loses_a_row(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ABC"), rng.randint(0, 500), *(round(rng.uniform(1, 90), 2) for _ in range(4)), rng.randint(0, 50)) for _ in range(900)]
    bars = spark.createDataFrame([(s, t, *map(float, p), v) for s, t, *p, v in rows], BAR).cache()
    for layout in LAYOUTS:
        build(spark, tmp_path, rows, 100, layout, 30, layout)
    for _ in range(12):
        filters = [f"{rng.choice(COLUMNS[1:])}{rng.choice(['=', '>', '>=', '<', '<='])}{rng.randint(0, 90)}" for _ in range(rng.randint(0, 2))] + [f"symbol={rng.choice('ABCD')}"] * rng.randint(0, 1)
        tokens = ["count", "sum:volume", "avg:close", "min:low", "max:timestamp"]
        want = [r.asDict() for r in run(bars, query_of("t", tokens, filters), exact=True).collect()]
        for layout in LAYOUTS:
            root, q = str(tmp_path), query_of(layout, tokens, filters)
            p = plan(spark, root, q)
            assert [r.asDict() for r in frame(spark, root, p, exact=True).collect()] == want, filters
            named = {int(c["chunk_id"]) for c in p.candidates}
            everything = spark.read.parquet(Table(root, layout).chunks)
            condition = row_matches(q.filters)
            hit = everything if condition is None else everything.where(condition)
            assert {r[0] for r in hit.select("chunk_id").distinct().collect()} <= named


def test_planning_here_and_in_spark_agree(spark, tmp_path, monkeypatch):
    from barloom.plans import planner

    rng = random.Random(8)
    rows = [(rng.choice("ABC"), rng.randint(0, 99), 1.0, 2.0, 0.5, rng.choice([float("nan"), 1.0, 50.0, 90.0]), rng.randint(0, 9)) for _ in range(120)]
    build(spark, tmp_path, rows, 20, "symbol_time", 4)
    root = str(tmp_path)
    for filters in ([], ["close>60"], ["close<2", "symbol=B"], ["close=50", "volume>=8"], ["timestamp<=3"], ["symbol=Z"]):
        q = query_of("bars", ["count"], filters)
        here = planner.plan(spark, root, q)
        work = planner.work_of(spark, root, here)
        with monkeypatch.context() as m:
            m.setattr(planner, "MOST_HERE", -1)
            assert [c["chunk_id"] for c in planner.plan(spark, root, q).candidates] == [c["chunk_id"] for c in here.candidates]
            assert planner.work_of(spark, root, here) == work


def test_zone_maps_are_sure_with_nan(spark):
    rows = spark.createDataFrame([("A", i, 1.0, 1.0, 1.0, c, 1) for i, c in enumerate([float("nan"), 200.0, 1.0, 2.0])], BAR)
    placed = with_chunks(number_rows(rows, "time"), 2, 1)
    kept = chunk_statistics(placed).where(run_may_match([Filter("close", ">", 150.0)])).select("chunk_id").collect()
    assert 0 in {r[0] for r in kept}
    assert block_statistics(placed).count() == 4


def test_encodings(spark):
    rows = spark.createDataFrame([(s, t, 1.0, 1.0, 1.0, 10.5 + i, 100 + i) for i, (s, t) in enumerate([("B", 5), ("A", 7), ("B", 9), ("C", 11)])], BAR)
    placed = with_chunks(number_rows(rows, "time"), 3, 2)
    assert [r.id for r in encodings.dictionary_ids(placed).orderBy("rn").collect()] == [0, 1, 0, 0]
    assert [r.value for r in encodings.dictionary_values(encodings.dictionary_ids(placed), encodings.dictionary(placed)).orderBy("rn").collect()] == ["B", "A", "B", "C"]
    assert [(r.base, r.offset) for r in encodings.offsets(placed).orderBy("rn").collect()] == [(5, 0), (5, 2), (5, 4), (11, 0)]
    assert [r.value for r in encodings.from_offsets(encodings.offsets(placed)).orderBy("rn").collect()] == [5, 7, 9, 11]
    assert [r.close for r in encodings.row_range(placed, 1, 3).orderBy("rn").collect()] == [11.5, 12.5] and encodings.row_range(placed, 2, 2).count() == 0
    for a, b in ((-1, 2), (3, 1), (0, 5)):
        with pytest.raises(ValueError):
            encodings.row_range(placed, a, b)
    doubles = spark.createDataFrame([(x,) for x in (10.5, 10.8, 20.5, 21.5)], "x double")
    assert [r[0] for r in doubles.select(encodings.mask("x", low=15.0, include_low=False)).collect()] == [0, 0, 1, 1]
    longs = spark.createDataFrame([(x,) for x in (0, 10, 20, 30)], "x long")
    assert [r[0] for r in longs.select(encodings.mask("x", 10, 30, True, False)).collect()] == [0, 1, 1, 0]


def test_generators(spark, tmp_path):
    path = str(tmp_path / "g.csv")
    assert generator.write_csv(path, ["AAPL", "MSFT"], 12, 1_700_000_000) == 12
    rows = list(csv.DictReader(open(path)))
    assert list(rows[0]) == COLUMNS and [r["symbol"] for r in rows[:4]] == ["AAPL", "MSFT"] * 2 and int(rows[-1]["timestamp"]) == 1_700_000_000 + 11 * 60
    big = generator.spread(spark, ["A", "B"], 1000)
    assert big.schema.names == COLUMNS and big.where("low > least(open, close) OR high < greatest(open, close)").count() == 0
    assert statistics.fmean(r.volume for r in big.select("volume").collect()) > 1e6
    for wrong in (([], 1), (["A"], 0)):
        with pytest.raises(ValueError):
            generator.write_csv(path, *wrong)


def test_ingest(spark, tmp_path):
    t = Table(str(tmp_path), "bars")
    path = write(tmp_path / "a.csv", SIX)
    assert ingest_csv(spark, str(tmp_path), "bars", path)[0] == 6
    assert ingest_csv(spark, str(tmp_path), "bars", path)[0] == 6
    assert read_log(spark, t).count() == 12
    odd = write(tmp_path / "odd.csv", [('sym ""q"" ,x', " 7 ", "nan", "inf", "1e2", "3", "4"), ("", "8", "1", "1", "1", "1", "1")])
    assert ingest_csv(spark, str(tmp_path), "odd", odd)[0] == 2
    got = read_log(spark, Table(str(tmp_path), "odd")).orderBy("timestamp").collect()
    assert (got[0].symbol, got[0].timestamp, got[0].low, got[1].symbol) == ('sym ""q"" ,x', 7, 100.0, "")
    for n, bad in enumerate((["A", "1", "", "1", "1", "1", "1"], ["A", "1.5", "1", "1", "1", "1", "1"], ["A", "1", "1", "1", "1", "1", "9" * 19])):
        with pytest.raises(Exception):  # noqa: B017 - Spark's own kinds
            ingest_csv(spark, str(tmp_path), f"bad{n}", write(tmp_path / f"bad{n}.csv", [bad]))
    with pytest.raises(ValueError):
        ingest_csv(spark, str(tmp_path), "head", write(tmp_path / "head.csv", SIX, COLUMNS[::-1]))
    assert not store.exists(spark, f"{tmp_path}/head")
    with pytest.raises(ValueError):
        Table(str(tmp_path), "../x")


def test_compaction_checks(spark, tmp_path):
    root = str(tmp_path)
    for bad in ({"chunk_rows": 0}, {"block_rows": 0}, {"layout": "volume"}):
        with pytest.raises(ValueError):
            compact(spark, root, "none", **bad)
    with pytest.raises(FileNotFoundError):
        compact(spark, root, "none")
    with pytest.raises(FileNotFoundError):
        execute(spark, root, query_of("none", ["count"]))
    build(spark, tmp_path, SIX, 4)
    with pytest.raises(FileExistsError):
        compact(spark, root, "bars")
    store.remove(spark, Table(root, "bars").manifest)
    with pytest.raises(FileExistsError):
        compact(spark, root, "bars")
    append(spark, Table(root, "bare"), spark.createDataFrame([], BAR))
    with pytest.raises(ValueError):
        compact(spark, root, "bare")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", SIX)
    args = (spark, str(tmp_path), "s", str(tmp_path / "in"), str(tmp_path / "cp"))
    assert ingest_stream(*args) == 6
    write(tmp_path / "in" / "b.csv", SIX[:2])
    assert ingest_stream(*args) == 2 and ingest_stream(*args) == 0
    assert read_log(spark, Table(str(tmp_path), "s")).count() == 8
    coarse = windowed(spark.createDataFrame(SIX, BAR), "1 minute").where(F.col("symbol") == "AAPL").collect()
    assert sum(r.volume for r in coarse) == 220 and max(r.high for r in coarse) == 12.0


def test_command_line(spark, tmp_path, capsys):
    root, path = str(tmp_path / "db"), str(tmp_path / "c.csv")
    say = lambda *a: (main(list(a), spark), capsys.readouterr())
    assert say("generate", "--symbols", "AAPL, MSFT", "--rows", "40", "--output", path)[1].out.startswith("generated 40 rows")
    assert say("ingest", "--table", "t", "--root", root, "--file", path)[1].out.startswith("ingested 40 rows")
    assert say("compact", "--table", "t", "--root", root, "--chunk-size", "10", "--layout", "symbol_time")[1].out.startswith("compacted 40 rows into 4 chunks")
    code, out = say("query-plan", "--table", "t", "--root", root, "--agg", "count", "--filter", "symbol=AAPL")
    assert code == 0 and json.loads(out.out)["selected_chunk_count"] == 2
    code, out = say("query", "--table", "t", "--root", root, "--agg", "count", "--group-by", "symbol", "--disable-native-scan")
    assert code == 0 and json.loads(out.out)["rows"] == [{"symbol": "AAPL", "count": 20}, {"symbol": "MSFT", "count": 20}]
    assert "Scan parquet" in say("query-plan", "--table", "t", "--root", root, "--agg", "count", "--physical")[1].out
    code, out = say("query", "--table", "none", "--root", root, "--agg", "count")
    assert code == 1 and "FileNotFoundError" in out.err
    code, out = say("demo", "--root", str(tmp_path / "demo"), "--rows", "2000")
    assert code == 0 and len({d["rows"][0]["sum_volume"] for d in json.loads(out.out)}) == 1
