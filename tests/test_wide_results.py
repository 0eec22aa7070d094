"""Sums beyond 64 bits, many surviving chunks, staged copies, the pushed column."""

import os

import pytest
from test_engine import SIX, build

from barloom.operators import encodings, execution
from barloom.operators.execution import execute, runs_of
from barloom.operators.layout import number_rows, with_chunks
from barloom.plans.planner import pushdown
from barloom.plans.tokens import query_of
from barloom.schema import BAR

BIG = 2**63 - 1


def test_sums_of_any_size(spark, tmp_path):
    rows = [("A", t, 1.0, 1.0, 1.0, 1.0, BIG - t) for t in range(4)] + [("B", 9, 1.0, 1.0, 1.0, 1.0, 7), ("C", 9, 1.0, 1.0, 1.0, 1.0, -BIG), ("C", 10, 1.0, 1.0, 1.0, 1.0, BIG)]
    build(spark, tmp_path, rows, 3)
    total = execute(spark, str(tmp_path), query_of("bars", ["sum:volume", "count", "avg:volume"], []))
    assert total.rows == [{"sum_volume": 4 * BIG - 6 + 7, "count": 7, "avg_volume": float(4 * BIG + 1) / 7}]
    by_symbol = execute(spark, str(tmp_path), query_of("bars", ["sum:volume"], [], ["symbol"]))
    assert by_symbol.rows == [{"symbol": "A", "sum_volume": 4 * BIG - 6}, {"symbol": "B", "sum_volume": 7}, {"symbol": "C", "sum_volume": 0}]
    assert all(type(r["sum_volume"]) is int for r in by_symbol.rows)
    assert execute(spark, str(tmp_path), query_of("bars", ["sum:volume"], ["symbol=none"])).rows == [{"sum_volume": 0}]


@pytest.mark.parametrize("named", [0, 1, 100])
def test_only_surviving_chunks_are_read(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(execution, "FEW", 0)
    monkeypatch.setattr(execution, "MOST_NAMED", named)
    rows = [("A" if i % 3 else "B", i, 1.0, 1.0, 1.0, float(i), i) for i in range(40)]
    build(spark, tmp_path, rows, 2, "time")
    q = query_of("bars", ["sum:volume", "count"], ["symbol=B", "close>=9"])
    want = [i for i in range(9, 40) if i % 3 == 0]
    found = execute(spark, str(tmp_path), q)
    assert found.rows == [{"sum_volume": sum(want), "count": len(want)}]
    p = execution.make_plan(spark, str(tmp_path), q)
    ids = {int(c["chunk_id"]) for c in p.candidates}
    assert {r[0] for r in execution.bars_of(spark, str(tmp_path), p).select("chunk_id").distinct().collect()} == ids and len(ids) < 20


def test_runs_of_numbers():
    assert runs_of([]) == [] and runs_of([4]) == [(4, 4)] and runs_of([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]


def test_compaction_leaves_no_copy(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    build(spark, tmp_path, SIX, 2)
    assert set(os.listdir(shared)) == before


def test_offsets_need_rows(spark):
    rows = spark.createDataFrame([("A", 5, 1.0, 1.0, 1.0, 1.0, 1)], BAR)
    placed = with_chunks(number_rows(rows, "time"), 3, 2)
    assert [r.offset for r in encodings.offsets(placed).collect()] == [0]
    with pytest.raises(ValueError):
        encodings.offsets(placed.limit(0))
    assert [tuple(r) for r in encodings.plain(placed, "close", "volume").collect()] == [(0, 0, 1.0, 1)]


def test_the_pushed_column():
    at = lambda *filters: (p := pushdown(query_of("t", ["count"], list(filters)))) and (p.column, p.low, p.high, p.include_low, p.include_high)
    assert at("symbol=A") is None
    assert at("symbol=A", "volume>3", "close=2") == ("volume", 3, None, False, True)
    assert at("close>1", "close=2", "close<9") == ("close", 2.0, 2.0, True, True)
    assert at("low>=2", "low>2", "low>1", "low<=8", "low<8", "low<9") == ("low", 2.0, 8.0, False, False)


def test_spread_bars_do_not_depend_on_runs_or_partitions(spark, monkeypatch):
    from barloom.sources import generator

    def made(n):
        return sorted(map(tuple, generator.spread(spark, ["A", "B", "C"], n).collect()))

    whole = made(900)
    monkeypatch.setattr(generator, "RUN_ROWS", 7)
    again = made(900)
    assert [r[:2] for r in again] == [r[:2] for r in whole]
    assert all(a[2:6] == pytest.approx(b[2:6], abs=2e-4) and a[6] == b[6] for a, b in zip(whole, again, strict=True))
    for s in "ABC":
        own = sorted((r for r in whole if r[0] == s), key=lambda r: r[1])
        assert all(a[5] == pytest.approx(b[2], abs=2e-4) for a, b in zip(own, own[1:], strict=False))
        assert all(r[4] <= min(r[2], r[5]) and r[3] >= max(r[2], r[5]) and 50_000 <= r[6] <= 5_000_000 for r in own)
