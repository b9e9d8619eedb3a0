"""Latest-first cuts, merging of overlapping runs, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import KEPT_WINDOWS
from ..session import collect_bounded

# Above this many rows a top-k is narrowed down by time first.
LARGE_COUNT = 10_000
# Hours or seconds whose counts are read to find where to cut.
MAX_STEPS = 200_000
SALTS = 64

# Columns that make the order of equal timestamps certain, where present.
_TIE_BREAKERS = ("log_id", "source", "window_id", "alert_type", "ip", "url", "url_path",
                 "status_code", "body_bytes_sent", "raw_line", "message")


def latest_first(df: DataFrame, time: str = "timestamp"):
    present = set(df.columns)
    return [F.col(time).desc_nulls_last()] + [
        F.col(c).desc_nulls_last() for c in _TIE_BREAKERS if c in present]


def top_recent(df: DataFrame, count: int, time: str = "timestamp") -> DataFrame:
    """The latest ``count`` rows: a per-task top-k, then one of the survivors.

    As every task hands over up to ``count`` rows, a large count is first narrowed down
    to the stretch of time that holds the rows.
    """
    if count > LARGE_COUNT:
        df = _narrowed(df, count, time)
    return df.orderBy(*latest_first(df, time)).limit(count)


def _narrowed(df: DataFrame, count: int, time: str) -> DataFrame:
    """Rows from the latest hour (then second) on that together hold ``count`` rows."""
    above = 0
    for unit in ("hour", "second"):
        start = F.date_trunc(unit, time)
        counted = collect_bounded(
            df.filter(F.col(time).isNotNull()).groupBy(F.unix_micros(start).alias("at"))
            .agg(F.count(F.lit(1)).alias("n")), MAX_STEPS)
        if counted is None:
            break
        for row in sorted(counted, key=lambda r: -r["at"]):
            if above + row["n"] >= count:
                break
            above += row["n"]
        else:
            break
        first = F.timestamp_micros(F.lit(row["at"]))
        rest = df.filter(F.col(time) >= first)
        if row["n"] <= 10 * count:
            return rest
        # One hour holds far more than is wanted: look at its seconds.
        above, df = 0, rest
    return df


def cap_recent(df: DataFrame, count: int, by: str | None = None,
               time: str = "timestamp") -> DataFrame:
    """Retention: the latest ``count`` rows, of everything or of each ``by``.

    With ``by`` the cut is made in every task before the shuffle, then per salt, then per
    group, so that no task sorts more of a busy group than its share.
    """
    if by is None:
        return top_recent(df, count, time)
    order = latest_first(df, time)
    salt = F.pmod(F.xxhash64(time, *[c for c in _TIE_BREAKERS if c in df.columns]),
                  F.lit(SALTS))
    for keys in ((F.col(by), salt), (F.col(by),)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        df = df.withColumn("_rank", place).filter(F.col("_rank") <= count).drop("_rank")
    return df


def merge_features(existing: DataFrame, fresh: DataFrame,
                   keep: int | None = None) -> DataFrame:
    """Union of two feature tables, the existing row winning for equal windows.

    All rows are kept, or the latest ``keep``.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        fresh.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    columns = existing.columns
    keys = [c for c in ("source", "timestamp") if c in columns]
    order = [F.col("_batch")] + ([F.col("window_id")] if "window_id" in columns else [])
    first = Window.partitionBy(*keys).orderBy(*order)
    merged = (both.withColumn("_rank", F.row_number().over(first))
              .filter("_rank = 1").select(*columns))
    return merged if keep is None else top_recent(merged, keep)
