"""CSV and JSON exports with times as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def for_csv(df: DataFrame) -> DataFrame:
    """Timestamps as text, everything else as it is."""
    times = {c: F.col(c).cast("string") for c, kind in df.dtypes
             if kind in ("timestamp", "timestamp_ntz")}
    return df.withColumns(times) if times else df


def for_json(alerts: DataFrame) -> DataFrame:
    """Timestamps in ISO form; microseconds only where there are any."""
    whole = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    has_fraction = F.date_format("timestamp", "SSSSSS") != "000000"
    return alerts.withColumn("timestamp", F.when(has_fraction, exact).otherwise(whole))


def _csv(df: DataFrame, path: str, mode: str) -> None:
    # Quotes inside a field are doubled, as spreadsheet programs expect.
    (for_csv(df).write.mode(mode).option("header", True).option("escape", '"').csv(path))


def export_logs_csv(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    _csv(logs, path, mode)


def export_features_csv(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    _csv(features, path, mode)


def export_alerts_json(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    for_json(alerts).write.mode(mode).json(path)
