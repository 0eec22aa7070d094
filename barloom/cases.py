"""The query cases that speed and scan work are measured on."""

from __future__ import annotations

from dataclasses import dataclass

SYMBOLS = ["AAPL", "MSFT", "NVDA", "AMZN", "GOOG", "META", "TSLA", "AMD", "AVGO", "SPY"]


@dataclass(frozen=True)
class Case:
    name: str
    aggregations: list[str]
    filters: list[str]


def window(first: int, last: int, start: float, width: float) -> tuple[int, int]:
    """A part of the time span, never beyond its end."""
    span = max(1, last - first)
    begin = first + int(span * start)
    return begin, min(last, begin + max(1, int(span * width)))


def _between(first: int, last: int, start: float, width: float) -> list[str]:
    a, b = window(first, last, start, width)
    return [f"timestamp>={a}", f"timestamp<={b}"]


def layout_cases(first: int, last: int, symbol: str = "NVDA") -> list[Case]:
    return [
        Case("full_scan_count", ["count"], []),
        Case("time_window_avg_close", ["avg:close"], _between(first, last, 0.45, 0.01)),
        Case("symbol_volume_sum", ["sum:volume"], [f"symbol={symbol}"]),
        Case("symbol_time_avg_close", ["avg:close"], [f"symbol={symbol}", *_between(first, last, 0.40, 0.05)]),
    ]


def block_cases(first: int, last: int, symbol: str = "NVDA") -> list[Case]:
    return [
        Case("narrow_time_window_avg_close", ["avg:close"], _between(first, last, 0.45, 0.001)),
        Case("narrow_symbol_time_avg_close", ["avg:close"], [f"symbol={symbol}", *_between(first, last, 0.40, 0.001)]),
    ]


def scan_cases(first: int, last: int, symbol: str = "NVDA", close: float = 150) -> list[Case]:
    return [
        Case("narrow_time_window_avg_close", ["avg:close"], _between(first, last, 0.45, 0.001)),
        Case("symbol_close_threshold_sum_volume", ["sum:volume"], [f"symbol={symbol}", f"close>{close:g}"]),
    ]
