"""Sums of doubles that are rounded once, so that neither the order of rows nor their partitions show.

Each value is cut into three whole numbers of 30 bits at most, scaled by the power of two of its level (32 binary
exponents); these add up exactly as longs, for up to 2**33 values of a group and level. A group has 67 levels at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels of the least and the greatest doubles, and the bits of a level's values below its power of two.
LEAST, GREATEST, BELOW = -34, 32, 54
PARTS = ("__high", "__middle", "__low")


def _finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))


def level(c: Column) -> Column:
    return F.when(_finite(c) & (c != 0), F.floor(F.log2(F.abs(c)) / 32).cast("int")).otherwise(0)


def partial(c: Column, at: Column) -> list[Column]:
    """Aggregates of values of one level; ``__odd`` adds up infinities and NaNs."""
    half = F.element_at(F.array(*(F.lit(2.0 ** (-16 * i)) for i in range(LEAST, GREATEST + 1))), at - LEAST + 1)
    whole = F.when(_finite(c), c * half * half * F.lit(2.0**BELOW))  # by halves, as the power itself can be beyond a double
    high = (whole / F.lit(2.0**60)).cast("long")
    rest = whole - high * F.lit(2.0**60)
    middle = (rest / F.lit(2.0**30)).cast("long")
    low = (rest - middle * F.lit(2.0**30)).cast("long")
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in zip(PARTS, (high, middle, low))]
    return [*sums, F.sum(F.when(~_finite(c), c)).alias("__odd")]


def total(parts: Column, odd: Column) -> Column:
    """From a group's array of (level, high, middle, low) the double next to the exact sum."""

    @F.pandas_udf("double")
    def rounded(groups):
        import pandas as pd

        def one(levels) -> float:
            n = sum((x["__high"] << 60) + (x["__middle"] << 30) + x["__low"] << 32 * (x["__level"] - LEAST) for x in levels)
            try:
                return n / (1 << BELOW - 32 * LEAST)  # whole numbers divide with one rounding
            except OverflowError:
                return float("inf") if n > 0 else float("-inf")

        return pd.Series([one([{k: int(v) for k, v in x.items()} for x in levels]) for levels in groups], dtype=float)

    return F.coalesce(odd, rounded(parts))
