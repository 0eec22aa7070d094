"""The small query language: filter, aggregate and group tokens.

    symbol=NVDA   close>150   timestamp>=1704067200      count   avg:close
"""

from __future__ import annotations

import re

from barloom.plans.spec import Aggregate, Filter, Query
from barloom.schema import COLUMNS, GROUPABLE, NUMERIC, WHOLE

FUNCTIONS = ("count", "sum", "avg", "min", "max")
_FILTER = re.compile(rf"({'|'.join(COLUMNS)})(<=|>=|=|<|>)(.+)")


def filter_of(token: str) -> Filter:
    m = _FILTER.match(token.strip())
    if not m:
        raise ValueError(f"{token!r} is no filter; one looks like symbol=AAPL or close>100")
    column, operator, value = m[1], m[2], m[3].strip()
    if column != "symbol":
        return Filter(column, operator, int(value) if column in WHOLE else float(value))
    if operator != "=":
        raise ValueError("symbol can only be compared by =")
    return Filter(column, operator, value)


def aggregate_of(token: str) -> Aggregate:
    text = token.strip()
    if text in ("count", "count:*"):
        return Aggregate("count")
    function, colon, column = (x.strip() for x in text.partition(":"))
    if not colon:
        raise ValueError(f"{token!r} is no aggregate; one is count or looks like avg:close")
    if function not in FUNCTIONS:
        raise ValueError(f"{function!r} is none of the functions {', '.join(FUNCTIONS)}")
    if function == "count":
        raise ValueError("count takes no column")
    if column not in NUMERIC:
        raise ValueError(f"{column!r} is {'not numeric' if column in COLUMNS else 'no column'}")
    return Aggregate(function, column)


def query_of(table: str, aggregates: list[str], filters: list[str] | None = None, group_by: list[str] | None = None) -> Query:
    """Filters are parsed first, then aggregates, then groups; the first error is the one raised."""
    if not aggregates:
        raise ValueError("a query needs an aggregate")
    wanted = [filter_of(t) for t in filters or []]
    found = [aggregate_of(t) for t in aggregates]
    keys = [a.key for a in found]
    if twice := [k for k in keys if keys.count(k) > 1]:
        raise ValueError(f"{twice[0]} is asked for twice")
    groups = list(dict.fromkeys(t.strip() for t in group_by or []))
    if wrong := [g for g in groups if g not in GROUPABLE]:
        raise ValueError(f"{wrong[0]!r} can't group")
    return Query(table, wanted, found, groups)
