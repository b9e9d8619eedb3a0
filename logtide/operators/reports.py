"""Counts and series shown to operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import (
    CLIENT_ERROR_CODES, ERROR_RATE_LOGS, RECENT_LOGS_SHOWN, RECENT_WINDOWS_SHOWN,
    SERVER_ERROR_CODES, SHOWN_LOG_COLUMNS, SUCCESS_CODES,
)
from ..functions.log_line import status_class
from .history import top_recent


def _side_by_side(frames: list[DataFrame]) -> DataFrame:
    """Frames of exactly one row each (global aggregates) as one row.

    Their union has one value and nulls in every column, so a maximum picks the value.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def db_statistics(logs: DataFrame, features: DataFrame, results: DataFrame,
                  alerts: DataFrame) -> DataFrame:
    """Row counts of the four tables and the latest log and feature times."""
    return _side_by_side([
        logs.agg(F.count(F.lit(1)).alias("total_logs"),
                 F.max("timestamp").alias("latest_log_time")),
        features.agg(F.count(F.lit(1)).alias("total_features"),
                     F.max("timestamp").alias("latest_feature_time")),
        _count(results, "total_anomaly_results"), _count(alerts, "total_alerts"),
    ])


def recent_error_rate(logs: DataFrame, count: int = ERROR_RATE_LOGS) -> DataFrame:
    """Percentage of server errors among the latest log rows."""
    return top_recent(logs, count).agg(F.coalesce(
        F.try_divide(F.count_if(F.col("status_code") >= 500), F.count(F.lit(1))) * 100,
        F.lit(0.0)).alias("error_rate"))


def dashboard_metrics(parsed: DataFrame, features: DataFrame, alerts: DataFrame) -> DataFrame:
    """Logs, parse success rate, anomaly alerts, windows and recent 5xx rate in one row.

    ``parsed`` holds the rejected lines too, told apart by ``parse_ok``.
    """
    good = F.count_if("parse_ok")
    return _side_by_side([
        parsed.agg(good.alias("total_logs"), F.coalesce(
            F.try_divide(good, F.count(F.lit(1))) * 100, F.lit(0.0)).alias("success_rate")),
        alerts.agg(F.count_if(F.col("alert_type") == "anomaly").alias("anomaly_count")),
        _count(features, "window_count"),
        recent_error_rate(parsed.filter("parse_ok")),
    ])


def display_projection(logs: DataFrame) -> DataFrame:
    return logs.select(*[c for c in SHOWN_LOG_COLUMNS if c in logs.columns])


def with_status_class(logs: DataFrame) -> DataFrame:
    return logs.withColumn("status_class", status_class(F.col("status_code")))


def status_summary(logs: DataFrame, count: int = RECENT_LOGS_SHOWN) -> DataFrame:
    """Successes, client and server errors among the latest rows, by the listed codes."""
    code = F.col("status_code")
    return top_recent(logs, count).agg(
        F.count_if(code.isin(*SUCCESS_CODES)).alias("success"),
        F.count_if(code.isin(*CLIENT_ERROR_CODES)).alias("client_errors"),
        F.count_if(code.isin(*SERVER_ERROR_CODES)).alias("server_errors"))


def status_counts(logs: DataFrame) -> DataFrame:
    return (logs.groupBy("status_code").agg(F.count(F.lit(1)).alias("log_count"))
            .orderBy(F.desc("log_count"), "status_code"))


def recent_logs(logs: DataFrame, count: int = RECENT_LOGS_SHOWN) -> DataFrame:
    return top_recent(logs, count)


def recent_features(features: DataFrame, count: int = RECENT_WINDOWS_SHOWN) -> DataFrame:
    return top_recent(features, count)


def series(features: DataFrame, column: str) -> DataFrame:
    """The ``(source, timestamp, value)`` line behind a chart, in time order."""
    return features.select("source", "timestamp", column).orderBy("source", "timestamp")


def series_anomaly(results: DataFrame, threshold: float | None = None) -> DataFrame:
    """Scores in time order, with the flag that colours a point and the threshold line."""
    return results.select("source", "timestamp", "anomaly_score", "is_anomaly",
                          F.lit(threshold).cast("double").alias("threshold")
                          ).orderBy("source", "timestamp")


def report(logs: DataFrame, features: DataFrame, alerts: DataFrame, model: str | None = None,
           as_of=None) -> DataFrame:
    """Totals, anomaly count and model name as one JSON document."""
    when = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    counts = _side_by_side([
        _count(logs, "l"), _count(features, "f"),
        alerts.agg(F.count(F.lit(1)).alias("a"),
                   F.count_if(F.col("alert_type") == "anomaly").alias("n"))])
    return counts.select(F.to_json(F.struct(
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(F.col("l").alias("total_logs"), F.col("f").alias("total_windows"),
                 F.col("a").alias("total_alerts"), F.col("n").alias("anomaly_count")
                 ).alias("statistics"),
        F.lit(model or "None").alias("model"), F.col("l").alias("logs_count"),
        F.col("f").alias("features_count"), F.col("a").alias("alerts_count"))).alias("report"))
