"""Exact quantiles of columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# Up to here the built-in exact aggregate is used; its buffer holds all distinct values.
DIRECT_ROWS = 1_000_000
BUCKETS = 4096
# Values left in the last bucket that are sorted and read.
LAST_BUCKET = 50_000


def exact_quantile(df: DataFrame, column: str, q: float,
                   direct_rows: int = DIRECT_ROWS, at_most: int | None = None) -> float | None:
    """Quantile with linear interpolation between neighbours; nulls and NaN are left out.

    ``at_most`` is a known bound of the number of rows; a small input then takes one pass.

    Infinite values take part in the order; between two different ones the lower is returned.

    Large inputs are narrowed down by counting into equal buckets between the current
    bounds, again and again, which moves at most one row per bucket and task. Equal
    values, however many, end up in one bucket of width zero.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    infinite = F.abs("v") == float("inf")
    direct = at_most is not None and at_most <= direct_rows
    total = values.agg(
        F.percentile("v", F.lit(q)).alias("p") if direct else F.lit(None).cast("double").alias("p"),
        F.count("v").alias("n"), F.count_if(infinite & (F.col("v") < 0)).alias("under"),
        F.count_if(infinite & (F.col("v") > 0)).alias("over"),
        F.min(F.when(~infinite, F.col("v"))).alias("lo"),
        F.max(F.when(~infinite, F.col("v"))).alias("hi")).first()
    found, n, under, over, lo, hi = total
    if n == 0:
        return None
    if n <= direct_rows and not under and not over:
        return found if direct else values.agg(F.percentile("v", F.lit(q)).alias("p")).first()["p"]
    position = q * (n - 1)
    rank = math.floor(position)
    if rank < under:
        below = -math.inf
    elif rank >= n - over:
        below = math.inf
    else:
        below = _value_at(values, rank - under, lo, hi)
    fraction = position - rank
    if fraction == 0 or below == math.inf or rank + 1 < under:
        return below
    following = values.agg(
        F.count_if(F.col("v") <= below).alias("covered"),
        F.min(F.when(F.col("v") > below, F.col("v"))).alias("next")).first()
    above = below if following["covered"] > rank + 1 else following["next"]
    if math.isinf(above) or math.isinf(below):
        return below
    return below + fraction * (above - below)


def _value_at(values: DataFrame, rank: int, lo: float, hi: float) -> float:
    """The value with ``rank`` smaller-or-equal predecessors in sorted order."""
    before = 0
    while True:
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        if lo == hi:
            return lo
        # Halves, as the range itself may be larger than a double.
        place = F.floor((F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * BUCKETS)
        buckets = (inside.groupBy(F.least(place, F.lit(BUCKETS - 1)).alias("b"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                        F.max("v").alias("hi")).orderBy("b").collect())
        for bucket in buckets:
            if before + bucket["n"] > rank:
                break
            before += bucket["n"]
        if (bucket["lo"], bucket["hi"]) == (lo, hi):
            raise ArithmeticError(f"values between {lo} and {hi} cannot be told apart")
        lo, hi = bucket["lo"], bucket["hi"]
        if bucket["n"] <= LAST_BUCKET and lo < hi:
            rows = (values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
                    .orderBy("v").collect())
            return rows[rank - before]["v"]
