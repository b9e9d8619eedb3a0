"""Schemas of the parsed log and of the four stored tables."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PARSED_LOG = _schema(
    ("ip", T.StringType()),
    ("remote_user", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("method", T.StringType()),
    ("url", T.StringType()),
    ("url_path", T.StringType()),
    ("protocol", T.StringType()),
    ("status_code", T.IntegerType()),
    ("body_bytes_sent", T.LongType()),
    ("http_referer", T.StringType()),
    ("user_agent", T.StringType()),
    ("response_time", T.DoubleType()),
    ("raw_line", T.StringType()),
)

# Stored tables. `source` and the window start are the natural key, `event_date`
# is the partition column and `created_at` the time of the write.
LOGS_TABLE = _schema(
    ("source", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("ip", T.StringType()),
    ("method", T.StringType()),
    ("url_path", T.StringType()),
    ("status_code", T.IntegerType()),
    ("response_time", T.DoubleType()),
    ("body_bytes_sent", T.LongType()),
    ("user_agent", T.StringType()),
    ("raw_log", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
)

FEATURES_TABLE = _schema(
    ("source", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("window_start", T.TimestampType()),
    ("rps", T.DoubleType()),
    ("error_rate_5xx", T.DoubleType()),
    ("error_rate_4xx", T.DoubleType()),
    ("error_rate_404", T.DoubleType()),
    ("avg_response_time", T.DoubleType()),
    ("max_response_time", T.DoubleType()),
    ("min_response_time", T.DoubleType()),
    ("unique_ips", T.LongType()),
    ("unique_paths", T.LongType()),
    ("features_json", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
)

ANOMALY_RESULTS_TABLE = _schema(
    ("source", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("window_start", T.TimestampType()),
    ("anomaly_score", T.DoubleType()),
    ("is_anomaly", T.BooleanType()),
    ("model_type", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
)

ALERTS_TABLE = _schema(
    ("source", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("alert_type", T.StringType()),
    ("message", T.StringType()),
    ("severity", T.StringType()),
    ("metadata", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
)

REJECTS_TABLE = _schema(
    ("source", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("raw_line", T.StringType()),
    ("line_start", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
)
