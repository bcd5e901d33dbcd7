"""The five aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..types import INT_MAX, INT_MIN


def saturating_sum(column: Column) -> Column:
    """Of 64-bit integers, stopping at the ends of their range; NULL over no values.  Decimals of 38 digits
    hold the sum of 10^19 such values, so the clamp is exact, and partial sums combine as usual."""
    total = F.sum(column.cast("decimal(19,0)"))
    return F.when(total > F.lit(INT_MAX).cast("decimal(38,0)"), F.lit(INT_MAX)).when(total < F.lit(INT_MIN).cast("decimal(38,0)"), F.lit(INT_MIN)).otherwise(total.cast("bigint"))


def aggregate(function: str, column: str | None, integer: bool) -> Column:
    value = F.lit(1) if column is None else F.col(f"`{column}`")
    if function == "count":
        return F.count(value)
    if function == "sum":
        return saturating_sum(value) if integer else F.sum(value)
    if function == "avg":
        return F.avg(value.cast("double"))
    return F.min(value) if function == "min" else F.max(value)
