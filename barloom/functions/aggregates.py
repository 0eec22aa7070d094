"""Aggregates as column expressions, all of one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.plans.spec import Aggregate
from barloom.schema import WHOLE


def aggregate(a: Aggregate, exact: bool = False, whole: str = "long") -> Column:
    """An aggregate under its result key. A sum over no rows is 0; other empty results are null.

    whole: sums of whole numbers as "long" (beyond 64 bits they raise), "decimal"
    (38 digits), or "try" (longs, null beyond 64 bits).

    exact: prices are added as decimals of 4 places, so the order of rows can't
    change a digit (right for prices of up to 4 decimals). Averages of whole
    columns are exact in either case.
    """
    if a.function == "count":
        return F.count(F.lit(1)).alias(a.key)
    c = F.col(a.column)
    if a.function in ("min", "max"):
        return getattr(F, a.function)(c).alias(a.key)
    if a.column in WHOLE:
        if a.function == "sum":
            if whole == "try":
                return F.when(F.count(c) == 0, F.lit(0).cast("long")).otherwise(F.try_sum(c)).alias(a.key)
            kind = "decimal(38,0)" if whole == "decimal" else "long"
            return F.coalesce(F.sum(c.cast(kind)), F.lit(0)).cast(kind).alias(a.key)
        return (F.sum(c.cast("decimal(38,0)")).cast("double") / F.count(c)).alias(a.key)
    if exact:
        total = F.sum(c.cast("decimal(18,4)")).cast("double")
        return (F.coalesce(total, F.lit(0.0)) if a.function == "sum" else total / F.count(c)).alias(a.key)
    return (F.coalesce(F.sum(c), F.lit(0.0)) if a.function == "sum" else F.avg(c)).alias(a.key)
