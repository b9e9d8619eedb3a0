"""Threshold and anomaly alerts over scored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    ALERT_MESSAGES, ALERT_SEVERITY, ANOMALY_ALERTS_CHECKED, ANOMALY_SCORE_THRESHOLD,
    ERROR_RATE_THRESHOLD, KEPT_ALERTS, RECENT_ALERTS_SHOWN, RESPONSE_TIME_THRESHOLD,
)
from ..functions.text import fixed_decimals
from .history import cap_recent, top_recent

VALUE_DIGITS = 9


def _message(kind: str, value: Column) -> Column:
    before, digits, after = ALERT_MESSAGES[kind]
    return F.concat(F.lit(before), fixed_decimals(value, digits), F.lit(after))


def alerts_every_window(windows: DataFrame, error_rate: float = ERROR_RATE_THRESHOLD,
                        response_time: float = RESPONSE_TIME_THRESHOLD,
                        anomaly_score: float = ANOMALY_SCORE_THRESHOLD,
                        rules: tuple[str, ...] = ("error_rate", "response_time", "anomaly")
                        ) -> DataFrame:
    """Alerts of every window, all rules in one pass over the windows.

    The anomaly rule needs ``anomaly_score`` and ``is_anomaly``; without them it is left out.
    Response times are compared as they are stored, whatever their unit.
    """
    present = set(windows.columns)
    fires = {
        "error_rate": ("error_rate_5xx", lambda v: v > error_rate),
        "response_time": ("avg_response_time", lambda v: v > response_time),
        "anomaly": ("anomaly_score", lambda v: F.coalesce(F.col("is_anomaly"), F.lit(False))
                    | F.coalesce(v > anomaly_score, F.lit(False))),
    }
    made = []
    for kind in rules:
        column, rule = fires[kind]
        if column not in present:
            continue
        exact = F.col(column).cast("double")
        # Sums of doubles differ in their last bits with the order of the rows; what is shown
        # is cut to fewer digits, but the rule sees the value as it is.
        value = F.round(exact, VALUE_DIGITS)
        made.append(F.when(rule(exact), F.struct(
            F.lit(kind).alias("alert_type"), _message(kind, value).alias("message"),
            F.lit(ALERT_SEVERITY[kind]).alias("severity"),
            value.alias("value"))))
    keys = [c for c in ("source", "window_id", "timestamp") if c in present]
    alert = F.explode(F.array_compact(F.array(*made)))
    return windows.select(*keys, alert.alias("a")).select(
        *keys, "a.alert_type", "a.message", "a.severity", "a.value")


def latest_window(windows: DataFrame, time: str = "timestamp") -> DataFrame:
    """The last window of each source, combined in every task before the shuffle."""
    whole = F.struct(*[F.col(c) for c in windows.columns])
    return (windows.groupBy("source").agg(F.max_by(whole, time).alias("w"))
            .select("w.*"))


def alerts_all(windows: DataFrame, **thresholds) -> DataFrame:
    """Alerts of the latest window of each source."""
    return alerts_every_window(latest_window(windows), **thresholds)


def alert_retention(alerts: DataFrame, keep: int = KEPT_ALERTS, by: str | None = None
                    ) -> DataFrame:
    return cap_recent(alerts, keep, by)


def alerts_recent(alerts: DataFrame, count: int = RECENT_ALERTS_SHOWN) -> DataFrame:
    """The latest alerts, each with the number of alerts there are in all."""
    total = alerts.agg(F.count(F.lit(1)).alias("total_count"))  # one row
    return top_recent(alerts, count).join(F.broadcast(total), F.lit(True))


def alert_count_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alert_count"))


def recent_anomaly_alerts(alerts: DataFrame, count: int = ANOMALY_ALERTS_CHECKED) -> DataFrame:
    """How many of the latest alerts are anomalies."""
    return top_recent(alerts, count).agg(
        F.count_if(F.col("alert_type") == "anomaly").alias("recent_anomalies"))
