"""A query over any frame of bars: filter, project, aggregate. Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.aggregates import aggregate
from barloom.functions.predicates import row_matches
from barloom.plans.spec import Query
from barloom.schema import COLUMNS

#: Hidden column of matched rows beside the aggregates.
MATCHED = "__matched"


def required_columns(query: Query) -> list[str]:
    """Columns that filters, aggregates and groups name, in schema order; none for a bare count."""
    used = {f.column for f in query.filters} | {a.column for a in query.aggregations} | set(query.group_by)
    return [c for c in COLUMNS if c in used]


def matching(bars: DataFrame, query: Query) -> DataFrame:
    """The rows that match, in the required columns."""
    condition = row_matches(query.filters)
    kept = bars if condition is None else bars.where(condition)
    return kept.select(*required_columns(query))


def run(bars: DataFrame, query: Query, exact: bool = False, matched: bool = False, whole: str = "long") -> DataFrame:
    """One row, or one row per group in ascending order; group columns first, then aggregates as asked. whole: see ``aggregate``."""
    columns = [aggregate(a, exact, whole) for a in query.aggregations]
    if matched:
        columns.append(F.count(F.lit(1)).alias(MATCHED))
    rows = matching(bars, query)
    return rows.groupBy(*query.group_by).agg(*columns).orderBy(*query.group_by) if query.group_by else rows.agg(*columns)
