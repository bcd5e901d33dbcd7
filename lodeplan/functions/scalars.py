"""Scalar rules: LIKE patterns and division."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def like_pattern(pattern: str) -> str:
    r"""A pattern for Spark's LIKE, which refuses a backslash before an ordinary character: there it stands for itself."""
    return re.sub(r"\\(?![%_\\])", r"\\\\", pattern)


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Whole numbers divide to whole numbers, towards zero; other numbers as doubles.  Division by 0 is an
    error for whole numbers and follows IEEE for others."""
    if whole:
        rest = a % b  # has the sign of a
        return ((a - rest).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("bigint")
    a, b = a.cast("double"), b.cast("double")
    # Spark in ANSI mode raises on a zero divisor of any type
    infinite = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), infinite)).otherwise(F.try_divide(a, b))

