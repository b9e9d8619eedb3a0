"""The stored tables: Parquet, one partition per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import ALERT_DEFAULTS
from ..operators.parse import dead_letter
from ..schemas import (
    ALERTS_TABLE, ANOMALY_RESULTS_TABLE, FEATURES_TABLE, LOGS_TABLE, REJECTS_TABLE,
)
from ..sources.tables import utc_date


def write_table(df: DataFrame, path: str, mode: str = "append", balanced: bool = True) -> None:
    """Append to a day-partitioned table.

    The rebalance hint gathers the rows of a day into few files of even size, splitting
    busy days over several tasks; rows are sorted by time within a file, so that its
    statistics prune. ``balanced=False`` writes as is (small micro-batches).
    """
    if balanced:
        df = df.hint("rebalance", F.col("event_date")).sortWithinPartitions(
            "event_date", "timestamp")
    df.write.mode(mode).partitionBy("event_date").parquet(path)


def _conform(df: DataFrame, schema) -> DataFrame:
    """Columns of a table in its order and types; missing ones null, times filled in."""
    present = set(df.columns)
    columns = []
    for f in schema:
        if f.name in present:
            value = F.col(f.name)
        elif f.name == "event_date":
            value = utc_date(F.col("timestamp"))
        elif f.name == "created_at":
            value = F.current_timestamp()
        else:
            value = F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def logs_table(logs: DataFrame) -> DataFrame:
    return _conform(logs.withColumnRenamed("raw_line", "raw_log"), LOGS_TABLE)


def features_table(features: DataFrame) -> DataFrame:
    """The main features as columns and all of them as one JSON document."""
    everything = F.to_json(F.struct(*features.columns))
    return _conform(features.withColumn("features_json", everything)
                    .withColumn("window_start", F.col("timestamp")), FEATURES_TABLE)


def anomaly_results_table(results: DataFrame) -> DataFrame:
    if "window_start" not in results.columns:
        results = results.withColumn("window_start", F.col("timestamp"))
    return _conform(results, ANOMALY_RESULTS_TABLE)


def alerts_table(alerts: DataFrame, as_of=None) -> DataFrame:
    """Alerts with the defaults for what is missing. Their key and value go to metadata."""
    present = set(alerts.columns)
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    filled = alerts.withColumn(
        "timestamp", F.coalesce(F.col("timestamp"), now) if "timestamp" in present else now)
    for name, default in ALERT_DEFAULTS.items():
        filled = filled.withColumn(
            name, F.coalesce(F.col(name), F.lit(default)) if name in present
            else F.lit(default))
    details = [c for c in ("window_id", "value") if c in present]
    if "metadata" in present:
        filled = filled.withColumn("metadata", F.coalesce(F.col("metadata"), F.lit("{}")))
    else:
        filled = filled.withColumn(
            "metadata", F.to_json(F.struct(*details)) if details else F.lit("{}"))
    return _conform(filled, ALERTS_TABLE)


def rejects_table(parsed: DataFrame, ingested=None) -> DataFrame:
    """Lines that did not parse, whole, under the time at which they came in (default: now)."""
    now = F.current_timestamp() if ingested is None else F.lit(ingested).cast("timestamp")
    return _conform(dead_letter(parsed).withColumn("timestamp", now), REJECTS_TABLE)


def write_logs(logs: DataFrame, path: str, **options) -> None:
    write_table(logs_table(logs), path, **options)


def write_features(features: DataFrame, path: str, **options) -> None:
    write_table(features_table(features), path, **options)


def write_anomaly_results(results: DataFrame, path: str, **options) -> None:
    write_table(anomaly_results_table(results), path, **options)


def write_alerts(alerts: DataFrame, path: str, as_of=None, **options) -> None:
    write_table(alerts_table(alerts, as_of), path, **options)


def write_rejects(parsed: DataFrame, path: str, ingested=None, **options) -> None:
    """Write the rejected lines of ``parsed``; its good ones are left out."""
    write_table(rejects_table(parsed, ingested), path, **options)
