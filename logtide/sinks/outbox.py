"""Alerts as messages for the enabled channels, kept in a table for a sender to deliver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EMAIL_SUBJECT_PREFIX, SEVERITY_LABEL_OTHER, SEVERITY_LABELS
from .exports import for_json

CHANNELS = ("email", "webhook")


def _subject(severity: Column, time: Column) -> Column:
    label = F.coalesce(_label(severity), F.lit(SEVERITY_LABEL_OTHER))
    return F.concat(F.lit(EMAIL_SUBJECT_PREFIX), label, F.lit(" - "),
                    F.date_format(time, "yyyy-MM-dd HH:mm:ss"))


def _label(severity: Column) -> Column:
    value = F.lit(None).cast("string")
    for name, label in SEVERITY_LABELS.items():
        value = F.when(severity == name, F.lit(label)).otherwise(value)
    return value


def alert_outbox(alerts: DataFrame, channels: Mapping[str, bool] | Sequence[str] = CHANNELS
                 ) -> DataFrame:
    """One row per alert and enabled channel: ``channel, subject, payload``.

    The channels are a fixed short list, so the fan-out is an explode of a literal array.
    """
    if isinstance(channels, Mapping):
        channels = [name for name, enabled in channels.items() if enabled]
    names = F.array(*[F.lit(c) for c in channels]) if channels else F.lit([]).cast("array<string>")
    iso = for_json(alerts).withColumn("_time", F.col("timestamp").cast("timestamp"))
    payload = F.to_json(F.struct(
        "message", "severity", "timestamp",
        F.struct(F.col("alert_type").alias("type"), "timestamp").alias("details")))
    keys = [c for c in ("source", "window_id") if c in alerts.columns]
    return (iso.withColumn("channel", F.explode(names))
            .select(*keys, F.col("_time").alias("timestamp"), "alert_type", "channel",
                    F.when(F.col("channel") == "email",
                           _subject(F.col("severity"), F.col("_time"))).alias("subject"),
                    payload.alias("payload")))


def write_outbox(alerts: DataFrame, path: str, channels=CHANNELS, mode: str = "append") -> None:
    alert_outbox(alerts, channels).write.mode(mode).parquet(path)
