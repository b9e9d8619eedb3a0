"""Scans of the stored tables: inclusive time range, newest first, limited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_SCAN_LIMIT, SCAN_LIMIT, TRAINING_DAYS
from ..operators.history import top_recent


def utc_date(time: Column) -> Column:
    """Day of an instant in UTC, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))


def _instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def time_range(df: DataFrame, start=None, end=None, time: str = "timestamp") -> DataFrame:
    """Rows with ``start <= time <= end``; either end may be open.

    On a stored table the same bounds are put on ``event_date``, so that only the
    partitions of those days are listed and read.
    """
    for bound, compare in ((start, "__ge__"), (end, "__le__")):
        if bound is None:
            continue
        limit = _instant(bound)
        df = df.filter(getattr(F.col(time), compare)(limit))
        if "event_date" in df.columns:
            df = df.filter(getattr(F.col("event_date"), compare)(utc_date(limit)))
    return df


def scan_logs(logs: DataFrame, start=None, end=None, limit: int = SCAN_LIMIT) -> DataFrame:
    return top_recent(time_range(logs, start, end), limit)


def scan_features(features: DataFrame, start=None, end=None, limit: int = SCAN_LIMIT
                  ) -> DataFrame:
    return top_recent(time_range(features, start, end), limit)


def scan_anomaly_results(results: DataFrame, start=None, end=None, limit: int = SCAN_LIMIT
                         ) -> DataFrame:
    return top_recent(time_range(results, start, end), limit)


def scan_alerts(alerts: DataFrame, start=None, end=None, limit: int = ALERT_SCAN_LIMIT
                ) -> DataFrame:
    return top_recent(time_range(alerts, start, end), limit)


def scan_rejects(rejects: DataFrame, start=None, end=None, limit: int = SCAN_LIMIT) -> DataFrame:
    return top_recent(time_range(rejects, start, end), limit)


def scan_recent_days(logs: DataFrame, as_of, days_back: int = TRAINING_DAYS,
                     limit: int | None = None) -> DataFrame:
    """Training input: all rows of the days up to ``as_of``, or the newest ``limit`` of them.
    """
    end = _instant(as_of)
    rows = time_range(logs, end - F.make_interval(days=F.lit(days_back)), end)
    return rows if limit is None else top_recent(rows, limit)
