"""Filters as column expressions: over rows, and over the statistics of a run of rows."""

from __future__ import annotations

import operator
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.plans.spec import Filter
from barloom.schema import PRICES, WHOLE

_COMPARE = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _literal(f: Filter) -> Column:
    if f.column in WHOLE and not -(1 << 63) <= f.value < 1 << 63:
        return F.lit(Decimal(f.value))  # compared as decimals, so it can't wrap
    return F.lit(f.value)


def row_matches(filters: list[Filter]) -> Column | None:
    """All filters hold. NaN prices never match: the check stands beside the comparison, which still reaches the scan."""
    parts = [_COMPARE[f.operator](F.col(f.column), _literal(f)) for f in filters]
    parts += [~F.isnan(c) for c in dict.fromkeys(f.column for f in filters if f.column in PRICES)]
    return reduce(operator.and_, parts) if parts else None


def run_may_match(filters: list[Filter]) -> Column | None:
    """A run of rows with these statistics could hold a match."""

    def part(f: Filter) -> Column:
        if f.column == "symbol":
            return F.array_contains("symbols", f.value)
        low, high, value = F.col(f"{f.column}_min"), F.col(f"{f.column}_max"), _literal(f)
        if f.operator == "=":
            return (low <= value) & (high >= value)
        return _COMPARE[f.operator](high if f.operator[0] == ">" else low, value)

    return reduce(operator.and_, map(part, filters)) if filters else None


def run_may_match_here(run: dict, filters: list[Filter]) -> bool:
    """run_may_match for statistics that are already on the driver. As in Spark, NaN is the largest number."""

    def part(f: Filter) -> bool:
        if f.column == "symbol":
            return f.value in run["symbols"]
        low, high = (float("inf") if x != x else x for x in (run[f"{f.column}_min"], run[f"{f.column}_max"]))
        if f.operator == "=":
            return low <= f.value <= high
        return _COMPARE[f.operator](high if f.operator[0] == ">" else low, f.value)

    return all(map(part, filters))
