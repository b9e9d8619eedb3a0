"""Every operator as a named query over the driver's tables, with its SQL where there is one."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks, sources
from ..constants import FEATURE_COLUMNS
from ..functions import (
    drop_undecodable, flatten_pattern, log_time, null_dash, response_time_of_line, url_path,
)
from ..operators import (
    alerts as A, autoencoder as AE, evaluation as E, history as H, isolation_forest as IF, models as M,
    parse as P, quantiles as Q, reports as R, scaling as S, similarity as K, windows as W,
)
from ..schemas import PARSED_LOG
from ..session import materialize, scratch_path
from ..streaming import (
    closed_windows, newest, read_batches, start_pipeline, store_parse_stats, stored_parse_stats,
)
from . import access_log as L, training as T
from .oracle import BLOCKS, COMMON, logs_select, rounded, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START, END, AS_OF = "2024-01-05 00:00:00", "2024-01-20 12:00:00", "2024-01-20 12:00:00"
LOOK_BACK = 240
KEYS = ("source", "window_id")
ALERT_LIMITS = {"response_time": 50.0}
PARSED = ", ".join(n for n in PARSED_LOG.names if n != "response_time") + ", response_time"


def comparable(df: DataFrame) -> DataFrame:
    """Times without zone and doubles to six places, so that engines agree on values."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            columns.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kind in ("double", "float"):
            columns.append(F.round(F.col(name).cast("double"), 6).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None, **blocks: str):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return comparable(build(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = sql(oracle, **blocks)
        return build

    return register


# --- inputs -----------------------------------------------------------------------

def stored_features(spark, sf):
    """Features written to a table first, for queries that use them more than once."""
    return materialize(L.features(spark, sf), "features")[0]


def scored(spark, sf, features=None):
    """Features with stand-in scores that SQL can compute too."""
    return (L.features(spark, sf) if features is None else features).select(
        *KEYS, "timestamp", F.col("timestamp").alias("window_start"), "error_rate_5xx",
        "avg_response_time", F.round("top_path_ratio", 6).alias("anomaly_score"),
        (F.col("error_rate_5xx") > 20).alias("is_anomaly"))


def alerts(spark, sf, features=None):
    return A.alerts_every_window(scored(spark, sf, features), **ALERT_LIMITS)


def failures(features):
    return features.filter("error_rate_5xx > 20").select(
        "source", F.col("timestamp").alias("failure_time"))


def vectors(spark, sf):
    return K.with_vector(stored_features(spark, sf)).select(*KEYS, "timestamp", "features")


def elements(df, keys, column):
    """A vector column as one row per element."""
    return df.select(*keys, F.posexplode(column).alias("position", "value"))


def log_files(spark, sf):
    """The access log as text files, one folder per source."""
    path = scratch_path(spark, "access-log")
    L.lines(spark, sf).select("source", "value").write.partitionBy("source").text(path)
    return path


def folder_source():
    return F.substring_index(sources.source_of_path("folder"), "=", -1)


def stored(spark, path):
    return spark.read.parquet(path)


ELEMENTS = ("SELECT {keys}, CAST(generate_subscripts({column}, 1) - 1 AS INTEGER) AS position, "
            "round(unnest({column}), 6) AS value FROM {table}")


# --- sources ----------------------------------------------------------------------

@query("read_log_batch",
       f"SELECT source, {rounded(['response_time'])}, ok AS parse_ok, "
       f"{PARSED.removesuffix(', response_time')} FROM parsed")
def _(spark, sf):
    return sources.read_log_batch(spark, log_files(spark, sf), source=folder_source(),
                                  on_bad_time="reject").select(
        "source", "response_time", "parse_ok",
        *[n for n in PARSED_LOG.names if n != "response_time"])


def _stream_to_table(spark, stream):
    out = scratch_path(spark, "stream-out")
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "stream-check"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


STREAMED = "SELECT source, raw_line, timestamp, status_code, url_path, ok AS parse_ok FROM parsed"


@query("read_log_stream", STREAMED)
def _(spark, sf):
    stream = sources.read_log_stream(spark, log_files(spark, sf), source=folder_source(),
                                     on_bad_time="reject")
    return _stream_to_table(spark, stream.select(
        "source", "raw_line", "timestamp", "status_code", "url_path", "parse_ok"))


@query("read_log_stream_growing", STREAMED)
def _(spark, sf):
    """One file per source that has grown between the two runs of the stream."""
    path = scratch_path(spark, "growing-log")
    lines = L.lines(spark, sf)
    half = lines.agg(F.expr("(min(log_id) + max(log_id)) div 2").alias("half")).first()["half"]
    rows, check = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check")
    for some in (lines.filter(F.col("log_id") <= half), lines):
        (some.select("source", "log_id", "value").repartition("source")
         .sortWithinPartitions("source", "log_id").drop("log_id")
         .write.mode("overwrite").partitionBy("source").text(path))
        stream = sources.read_log_stream(spark, path, source=F.substring_index(
            sources.source_of_path("folder", F.col("path")), "=", -1), follow=True,
            on_bad_time="reject").select(
            "source", "raw_line", "timestamp", "status_code", "url_path", "parse_ok")
        (stream.writeStream.format("parquet").option("path", rows)
         .option("checkpointLocation", check).trigger(availableNow=True).start()
         .awaitTermination())
    return spark.read.schema(stream.schema).parquet(rows)


@query("start_from_latest", STREAMED)
def _(spark, sf):
    """The log is written twice; only the files after the start of the collection count."""
    path = log_files(spark, sf)
    last = spark.read.text(path).agg(
        F.max("_metadata.file_modification_time").alias("t")).first()["t"]
    time.sleep(1.1)
    (L.lines(spark, sf).select("source", "value").write.mode("append")
     .partitionBy("source").text(path))
    start = F.lit(last) + F.expr("interval 1 millisecond")
    stream = sources.read_log_stream(spark, path, source=folder_source(),
                                     start_from_latest=start, on_bad_time="reject")
    return _stream_to_table(spark, stream.select(
        "source", "raw_line", "timestamp", "status_code", "url_path", "parse_ok"))


@query("clean_lines", "SELECT log_id, source, value FROM lines WHERE log_id % 10 <> 3")
def _(spark, sf):
    padded = L.lines(spark, sf).withColumn("value", F.when(
        F.col("log_id") % 10 == 3, F.lit(" \t ")).otherwise(
        F.concat(F.lit("\t "), F.col("value"), F.lit(" \r"))))
    return sources.clean_lines(padded)


@query("decode_ignore", "SELECT log_id, source, value FROM lines")
def _(spark, sf):
    broken = F.concat(F.col("value").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    return L.lines(spark, sf).withColumn("value", drop_undecodable(broken))


@query("multi_source",
       "SELECT source, count(*) AS line_count, count(*) FILTER (ok) AS parsed_count "
       "FROM parsed GROUP BY source")
def _(spark, sf):
    path = log_files(spark, sf)
    paths = [f"{path}/source=site{i}" for i in range(3)]
    return sources.read_log_batch(spark, paths, source=folder_source()).groupBy("source").agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if("parse_ok").alias("parsed_count"))


RANGE = f"timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'"


@query("scan_logs",
       "SELECT log_id, source, timestamp, ip, method, url_path, status_code, "
       f"{rounded(['response_time'])}, body_bytes_sent, user_agent FROM logs WHERE {RANGE} "
       "ORDER BY timestamp DESC, log_id DESC LIMIT 1000")
def _(spark, sf):
    return sources.scan_logs(L.logs(spark, sf), START, END).select(
        "log_id", "source", "timestamp", "ip", "method", "url_path", "status_code",
        "response_time", "body_bytes_sent", "user_agent")


@query("scan_features",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM features "
       f"WHERE {RANGE} ORDER BY timestamp DESC, source DESC LIMIT 1000")
def _(spark, sf):
    return _doubles(sources.scan_features(L.features(spark, sf), START, END))


def _doubles(df):
    """Counts as doubles, as the SQL rounds every feature alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in FEATURE_COLUMNS
                           if c in df.columns})


@query("scan_anomaly_results",
       "SELECT source, window_id, window_start, timestamp, anomaly_score, is_anomaly FROM scored "
       f"WHERE {RANGE} ORDER BY timestamp DESC, source DESC LIMIT 1000")
def _(spark, sf):
    return sources.scan_anomaly_results(scored(spark, sf), START, END).drop(
        "error_rate_5xx", "avg_response_time")


ALERT_ORDER = "ORDER BY timestamp DESC, source DESC, window_id DESC, alert_type DESC"


@query("scan_alerts",
       "SELECT source, timestamp, alert_type, message, severity FROM alerts "
       f"WHERE {RANGE} {ALERT_ORDER} LIMIT 100")
def _(spark, sf):
    return sources.scan_alerts(alerts(spark, sf), START, END).select(
        "source", "timestamp", "alert_type", "message", "severity")


@query("scan_recent_days",
       "SELECT log_id, source, timestamp, status_code FROM logs "
       f"WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY "
       f"AND timestamp <= TIMESTAMP '{AS_OF}' "
       "ORDER BY timestamp DESC, log_id DESC LIMIT 100000")
def _(spark, sf):
    return sources.scan_recent_days(L.logs(spark, sf), AS_OF, limit=100_000).select(
        "log_id", "source", "timestamp", "status_code")


# --- sinks ------------------------------------------------------------------------

@query("write_logs",
       "SELECT source, timestamp, ip, method, url_path, status_code, "
       f"{rounded(['response_time'])}, body_bytes_sent, user_agent, raw_line AS raw_log, "
       "CAST(timestamp AS DATE) AS event_date FROM logs")
def _(spark, sf):
    path = scratch_path(spark, "logs")
    sinks.write_logs(L.logs(spark, sf), path)
    return stored(spark, path).drop("created_at")


@query("write_features",
       "SELECT source, timestamp, timestamp AS window_start, "
       + rounded(["rps", "error_rate_5xx", "avg_response_time", "std_response_time",
                  "rps_change"]) + ", unique_ips, top_path_count FROM features")
def _(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_features(L.features(spark, sf), path)
    def kept(name, kind):
        return F.get_json_object("features_json", f"$.{name}").cast(kind).alias(name)
    return stored(spark, path).select(
        "source", "timestamp", "window_start", "rps", "error_rate_5xx", "avg_response_time",
        kept("std_response_time", "double"), kept("rps_change", "double"), "unique_ips",
        kept("top_path_count", "bigint"))


@query("write_anomaly_results",
       "SELECT source, timestamp, window_start, anomaly_score, is_anomaly, "
       "'isolation_forest' AS model_type FROM scored")
def _(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_anomaly_results(
        scored(spark, sf).withColumn("model_type", F.lit("isolation_forest")), path)
    return stored(spark, path).drop("created_at", "event_date")


@query("write_alerts",
       "SELECT source, timestamp, CASE WHEN window_id % 3 = 0 THEN 'unknown' ELSE alert_type END "
       "AS alert_type, CASE WHEN window_id % 5 = 0 THEN '' ELSE message END AS message, "
       "CASE WHEN window_id % 2 = 0 THEN 'medium' ELSE severity END AS severity, window_id "
       "FROM alerts")
def _(spark, sf):
    path = scratch_path(spark, "alerts")
    missing = alerts(spark, sf)
    for column, modulus in (("alert_type", 3), ("message", 5), ("severity", 2)):
        missing = missing.withColumn(column, F.when(
            F.col("window_id") % modulus != 0, F.col(column)))
    sinks.write_alerts(missing, path)
    return stored(spark, path).select(
        "source", "timestamp", "alert_type", "message", "severity",
        F.get_json_object("metadata", "$.window_id").cast("bigint").alias("window_id"))


@query("export_logs_csv",
       "SELECT log_id, source, CAST(timestamp AS VARCHAR) AS timestamp, ip, url, user_agent, "
       f"raw_line, status_code, {rounded(['response_time'])} FROM logs")
def _(spark, sf):
    path = scratch_path(spark, "logs-csv")
    sinks.export_logs_csv(L.logs(spark, sf).select(
        "log_id", "source", "timestamp", "ip", "url", "user_agent", "raw_line", "status_code",
        "response_time"), path)
    return (spark.read.option("header", True).option("escape", '"')
            .schema("log_id bigint, source string, timestamp string, ip string, url string, "
                    "user_agent string, raw_line string, status_code int, response_time double")
            .csv(path))


@query("export_features_csv",
       f"SELECT source, window_id, CAST(timestamp AS VARCHAR) AS timestamp, "
       f"{rounded(FEATURE_COLUMNS)} FROM features")
def _(spark, sf):
    path = scratch_path(spark, "features-csv")
    sinks.export_features_csv(L.features(spark, sf), path)
    columns = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return (spark.read.option("header", True)
            .schema(f"source string, window_id bigint, timestamp string, {columns}").csv(path))


@query("export_alerts_json",
       "SELECT source, window_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, "
       f"alert_type, message, severity, {rounded(['value'])} FROM alerts")
def _(spark, sf):
    path = scratch_path(spark, "alerts-json")
    sinks.export_alerts_json(alerts(spark, sf), path)
    return spark.read.schema(
        "source string, window_id bigint, timestamp string, alert_type string, message string, "
        "severity string, value double").json(path)


@query("alert_outbox",
       "SELECT source, window_id, timestamp, alert_type, channel, "
       "CASE WHEN channel = 'email' THEN '[로그 이상 탐지] ' || CASE severity WHEN 'low' THEN '낮음' "
       "WHEN 'medium' THEN '보통' WHEN 'high' THEN '높음' ELSE '알 수 없음' END || ' - ' "
       "|| strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS subject, "
       "message, severity, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS sent_time, "
       "alert_type AS detail_type FROM alerts, (SELECT unnest(['email', 'webhook']) AS channel)")
def _(spark, sf):
    def part(name):
        return F.get_json_object("payload", f"$.{name}")
    path = scratch_path(spark, "outbox")
    sinks.write_outbox(alerts(spark, sf), path)
    return stored(spark, path).select(
        *KEYS, "timestamp", "alert_type", "channel", "subject", part("message").alias("message"),
        part("severity").alias("severity"), part("timestamp").alias("sent_time"),
        part("details.type").alias("detail_type"))


# --- parsing ----------------------------------------------------------------------

PARSE_OUT = (f"SELECT log_id, source, {rounded(['response_time'])}, ok AS parse_ok, "
             f"{PARSED.removesuffix(', response_time')} FROM ")


def _parse_out(df):
    return df.select("log_id", "source", "response_time", "parse_ok",
                     *[n for n in PARSED_LOG.names if n != "response_time"])


@query("parse_nginx_combined", PARSE_OUT + "parsed")
def _(spark, sf):
    return _parse_out(L.parsed(spark, sf))


@query("parse_apache_combined", PARSE_OUT + "parsed")
def _(spark, sf):
    return _parse_out(P.parse_access_log(L.lines(spark, sf), log_type="apache",
                                         on_bad_time="reject"))


@query("parse_custom_pattern",
       "SELECT log_id, source, ip, method, url_path, status_code, body_bytes_sent, user_agent "
       "FROM parsed WHERE ok")
def _(spark, sf):
    """Lines without the identity and without quotes around the request, by a pattern of one's own."""
    combined = (r'^(\S+) \S+ (\S+) (\[[^\]]+\]) "(\S+) (\S+) (\S+)" (\d+) (\d+) '
                r'("[^"]*" "[^"]*").*$')
    own = (r'(\S++) (\S++) \[([^\]]++)\] (\S++) (\S++) (\S++) (\d++) (\d++) '
           r'"([^"]*+)" "([^"]*+)"')
    lines = L.lines(spark, sf).withColumn("value", F.regexp_replace(
        "value", combined, "$1 $2 $3 $4 $5 $6 $7 $8 $9"))
    return P.parsed_only(P.parse_access_log(lines, pattern=own, on_bad_time="reject")).select(
        "log_id", "source", "ip", "method", "url_path", "status_code", "body_bytes_sent",
        "user_agent")


# Common lines: cut before the referer, every second one with a response time behind.
COMMON_LINES = ("SELECT log_id, source, split_part(value, ' \"-\" ', 1) || CASE WHEN log_id % 2 = 0 "
                "THEN ' ' || list_last(string_split(value, ' ')) ELSE '' END AS value FROM lines")


def common_lines(lines):
    return lines.withColumn("value", F.concat(
        F.substring_index("value", ' "-" ', 1), F.when(
            F.col("log_id") % 2 == 0,
            F.concat(F.lit(" "), F.substring_index("value", " ", -1))).otherwise("")))


@query("parse_apache_common", PARSE_OUT + "common_parsed", common_lines=COMMON_LINES,
       common_parsed=logs_select(COMMON, 8, "common_lines"))
def _(spark, sf):
    return _parse_out(P.parse_access_log(common_lines(L.lines(spark, sf)), log_type="apache",
                                         log_format="common", on_bad_time="reject"))


@query("parse_dispatch",
       PARSE_OUT + "parsed WHERE log_id % 3 <> 2 UNION ALL "
       + PARSE_OUT + "as_common WHERE log_id % 3 = 2",
       as_common=logs_select(COMMON, 8))
def _(spark, sf):
    kind = F.element_at(F.array(F.lit("nginx"), F.lit("apache"), F.lit("apache")),
                        (F.col("log_id") % 3 + 1).cast("int"))
    form = F.when(F.col("log_id") % 3 == 2, "common").otherwise("combined")
    return _parse_out(P.parse_access_log(L.lines(spark, sf), log_type=kind, log_format=form,
                                         on_bad_time="reject"))


@query("parse_log_time",
       "SELECT event_id AS log_id, CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts) "
       "- CASE WHEN event_id % 2 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END END "
       "AS timestamp FROM events")
def _(spark, sf):
    events = L.read_table(spark, sf, "events")
    text = F.concat(
        F.when(F.col("event_id") % 97 == 0, "99").otherwise(F.date_format("ts", "dd")),
        F.date_format("ts", "/MMM/yyyy:HH:mm:ss"),
        F.when(F.col("event_id") % 2 == 0, " +0900").otherwise(" +00:00"))
    return events.select(F.col("event_id").alias("log_id"), log_time(text).alias("timestamp"))


@query("extract_path", "SELECT log_id, url, split_part(url, '?', 1) AS url_path FROM logs")
def _(spark, sf):
    return L.logs(spark, sf).select("log_id", "url", url_path(F.col("url")).alias("url_path"))


@query("extract_response_time",
       "SELECT event_id AS log_id, round(value, 6) AS response_time FROM events")
def _(spark, sf):
    return L.lines(spark, sf).select(
        "log_id", response_time_of_line(F.col("value")).alias("response_time"))


@query("null_dash", "SELECT log_id, remote_user, http_referer, user_agent FROM logs")
def _(spark, sf):
    return L.logs(spark, sf).select(
        "log_id", null_dash(F.coalesce("remote_user", F.lit("-"))).alias("remote_user"),
        "http_referer", "user_agent")


@query("parse_stats",
       "SELECT source, count(*) FILTER (ok) AS parsed_count, count(*) FILTER (NOT ok) "
       "AS error_count, count(*) AS total_count, "
       "round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate "
       "FROM parsed GROUP BY source")
def _(spark, sf):
    return P.parse_stats(L.parsed(spark, sf))


@query("ingest_summary",
       "SELECT count(*) AS processed, count(*) FILTER (ok) AS parsed, "
       "count(*) FILTER (NOT ok) AS failed FROM parsed")
def _(spark, sf):
    return P.ingest_summary(L.parsed(spark, sf))


@query("dead_letter",
       "SELECT log_id, source, raw_line, substr(raw_line, 1, 100) AS line_start "
       "FROM parsed WHERE NOT ok")
def _(spark, sf):
    return P.dead_letter(L.parsed(spark, sf))


@query("dead_letter_table",
       "SELECT source, raw_line, substr(raw_line, 1, 100) AS line_start FROM parsed WHERE NOT ok")
def _(spark, sf):
    """The rejects table, written and scanned."""
    path = scratch_path(spark, "rejects")
    sinks.write_rejects(L.parsed(spark, sf), path, ingested=AS_OF)
    return sources.scan_rejects(stored(spark, path), AS_OF, AS_OF, 1_000_000).select(
        "source", "raw_line", "line_start")


# Lines broken at every part, by their number.
BROKEN = ((1, "[", "("), (2, "/2024:", "/2024-"), (3, "HTTP/1.1", "HTTP 1 1"), (4, '1.1" ', '1.1" - '),
          (5, " - - ", " -- "), (6, '"Mozilla', "Mozilla"), (7, '1.1" 2', '1.1" 999999999992'))


@query("parse_error_breakdown", """
SELECT source, field, CASE field WHEN 'time' THEN 'malformed_timestamp' WHEN 'request' THEN 'invalid_url_format'
  WHEN 'status' THEN 'missing_status_code' ELSE 'unexpected_characters' END AS category, count(*) AS error_count
FROM (SELECT source, CASE
  WHEN NOT regexp_matches(raw_line, '^\\s*\\S+ - \\S+ ') THEN 'address'
  WHEN NOT regexp_matches(raw_line, '^\\s*\\S+ - \\S+ \\[[^\\]]+\\] ') THEN 'time'
  WHEN NOT regexp_matches(raw_line, '^\\s*\\S+ - \\S+ \\[[^\\]]+\\] "\\S+ \\S+ \\S+" ') THEN 'request'
  WHEN NOT regexp_matches(raw_line, '" [0-9]+ ') THEN 'status'
  WHEN NOT regexp_matches(raw_line, '" [0-9]+ [0-9]') THEN 'size'
  WHEN NOT regexp_matches(raw_line, '" [0-9]+ [0-9]+ "[^"]*" "[^"]*"') THEN 'agent'
  WHEN NOT regexp_matches(raw_line, '" [0-9]{1,9} ') THEN 'status'
  ELSE 'time' END AS field FROM parsed WHERE status_code IS NULL OR body_bytes_sent IS NULL) GROUP BY ALL""",
       raw_lines=BLOCKS["lines"], lines="SELECT log_id, source, CASE log_id % 13 " + " ".join(
           f"WHEN {k} THEN replace(value, '{a}', '{b}')" for k, a, b in BROKEN)
       + " ELSE value END AS value FROM raw_lines")
def _(spark, sf):
    value = F.col("value")
    broken = F.when(F.lit(False), value)
    for k, old, new in BROKEN:
        broken = broken.when(F.col("log_id") % 13 == k, F.replace(value, F.lit(old), F.lit(new)))
    lines = L.lines(spark, sf).withColumn("value", broken.otherwise(value))
    return P.parse_error_breakdown(P.parse_access_log(lines, on_bad_time="reject"))


# --- projections ------------------------------------------------------------------

@query("numeric_feature_vector",
       ELEMENTS.format(keys="source, window_id", column="features", table="vectors"))
def _(spark, sf):
    return elements(vectors(spark, sf), KEYS, "features")


@query("display_projection", "SELECT timestamp, ip, method, url_path, status_code FROM logs")
def _(spark, sf):
    return R.display_projection(L.logs(spark, sf))


@query("status_class",
       "SELECT log_id, status_code, CASE WHEN status_code >= 500 THEN 'server_error' "
       "WHEN status_code >= 400 THEN 'client_error' WHEN status_code IS NOT NULL THEN 'ok' END "
       "AS status_class FROM parsed")
def _(spark, sf):
    return R.with_status_class(L.parsed(spark, sf)).select(
        "log_id", "status_code", "status_class")


@query("time_range", f"SELECT log_id, timestamp FROM logs WHERE {RANGE}")
def _(spark, sf):
    return sources.time_range(L.logs(spark, sf), START, END).select("log_id", "timestamp")


# --- windows ----------------------------------------------------------------------

@query("window_assign",
       "SELECT log_id, source, window_id, t0 + to_seconds(CAST(window_id AS BIGINT) * 3600) "
       "AS window_start FROM anchored")
def _(spark, sf):
    return W.assign_windows(L.logs(spark, sf), L.HOUR).select(
        "log_id", "source", "window_id", "window_start")


@query("window_skip_empty",
       "SELECT source, count(DISTINCT window_id) AS window_count, "
       "max(window_id) - min(window_id) + 1 - count(DISTINCT window_id) AS skipped_count "
       "FROM anchored GROUP BY source")
def _(spark, sf):
    return L.features(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("window_count"),
        (F.max("window_id") - F.min("window_id") + 1 - F.count(F.lit(1)))
        .alias("skipped_count"))


def _feature_query(name: str, *columns: str):
    @query(name, f"SELECT source, window_id, {rounded(columns)} FROM features")
    def _(spark, sf):
        return _doubles(L.features(spark, sf).select(*KEYS, *columns))


_feature_query("f_total_rps", "total_requests", "rps")
_feature_query("f_error_rates", "error_rate_5xx", "error_rate_4xx", "error_rate_404")
_feature_query("f_response_time", "avg_response_time", "max_response_time",
               "min_response_time", "std_response_time")
_feature_query("f_unique_ips", "unique_ips")
_feature_query("f_top_ip", "top_ip_count")
_feature_query("f_paths", "unique_paths", "top_path_count", "top_path_ratio")
_feature_query("f_method_ratio", "get_ratio", "post_ratio")
_feature_query("f_change_rates", "rps_change", "error_rate_5xx_change",
               "error_rate_404_change", "avg_response_time_change")


@query("f_bytes_fallback",
       "SELECT source, window_id, round(avg(body_bytes_sent) / 1000, 6) AS avg_response_time, "
       "round(max(body_bytes_sent) / 1000, 6) AS max_response_time, "
       "round(min(body_bytes_sent) / 1000, 6) AS min_response_time, "
       "round(stddev_samp(body_bytes_sent) / 1000, 6) AS std_response_time "
       "FROM anchored GROUP BY source, window_id")
def _(spark, sf):
    without = L.logs(spark, sf).drop("response_time")
    return W.window_features(without, L.HOUR).select(
        *KEYS, "avg_response_time", "max_response_time", "min_response_time",
        "std_response_time")


@query("empty_window_defaults",
       "SELECT i.source, i.window_id, i.t0 + to_seconds(CAST(i.window_id AS BIGINT) * 3600) "
       "AS timestamp, " + ", ".join(
           f"CASE WHEN f.source IS NULL THEN 0.0 ELSE round(CAST(f.{c} AS DOUBLE), 6) END AS {c}"
           for c in FEATURE_COLUMNS) +
       " FROM (SELECT source, t0, unnest(generate_series(lo, hi)) AS window_id FROM "
       "(SELECT source, min(t0) AS t0, min(window_id) AS lo, max(window_id) AS hi "
       "FROM anchored GROUP BY source)) i LEFT JOIN features f USING (source, window_id)")
def _(spark, sf):
    return _doubles(L.features(spark, sf, fill_gaps=True))


@query("window_features",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM features")
def _(spark, sf):
    return _doubles(L.features(spark, sf))


@query("window_features_extra",
       "SELECT f.source, f.window_id, f.total_requests, e.total_bytes, e.post_bytes "
       "FROM features f JOIN (SELECT source, window_id, CAST(sum(body_bytes_sent) AS BIGINT) "
       "AS total_bytes, CAST(max(CASE WHEN method = 'POST' THEN body_bytes_sent END) AS BIGINT) "
       "AS post_bytes FROM anchored GROUP BY ALL) e USING (source, window_id)")
def _(spark, sf):
    return L.features(spark, sf, extra_aggs={
        "total_bytes": F.sum("body_bytes_sent"),
        "post_bytes": F.max(F.when(F.col("method") == "POST", F.col("body_bytes_sent")))}
    ).select(*KEYS, "total_requests", "total_bytes", "post_bytes")


@query("features_job", "SELECT count(*) AS window_count FROM features")
def _(spark, sf):
    return W.features_job(L.features(spark, sf))


# --- scaling ----------------------------------------------------------------------

@query("normalize_features", "SELECT source, window_id, " + ", ".join(
    f"round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN (CAST({c} AS DOUBLE) "
    f"- min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END, 6) AS {c}"
    for c in FEATURE_COLUMNS) + " FROM features")
def _(spark, sf):
    return S.normalize_features(stored_features(spark, sf)).drop("timestamp")


@query("ae_scale",
       "SELECT source, window_id, position, round((v - min(v) OVER p) / (max(v) OVER p "
       "- min(v) OVER p + 1e-8), 6) AS value FROM (SELECT source, window_id, "
       "CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS position, unnest(features) AS v "
       "FROM vectors) WINDOW p AS (PARTITION BY position)")
def _(spark, sf):
    rows = vectors(spark, sf)
    low, high, _ = S.vector_bounds(rows, "features")
    return elements(rows.withColumn("features", S.ae_scale(F.col("features"), low, high)),
                    KEYS, "features")


# --- models -----------------------------------------------------------------------

def small_forest():
    """Three trees of one split each, which SQL can apply to the same windows."""
    splits = ((2, 20.5, 6.0, 2.0), (9, 3.5, 5.0, 3.0), (13, 0.4321, 7.0, 2.5))
    nodes = []
    for tree, (feature, threshold, below, above) in enumerate(splits):
        nodes += [(tree, 0, feature, threshold, 1, 2, 0.0, 0), (tree, 1, -1, 0.0, 1, 1, below, 1),
                  (tree, 2, -1, 0.0, 2, 2, above, 1)]
    names = [part.split()[0] for part in IF.NODE_SCHEMA.split(", ")]
    return IF.IsolationForestModel(pd.DataFrame(nodes, columns=names), 256, -0.5,
                                   width=len(FEATURE_COLUMNS))


def small_forest_sql(table: str) -> str:
    return ("(SELECT *, anomaly_score < 0 AS is_anomaly FROM (SELECT *, 0.5 - power(2, "
            "-(CASE WHEN error_rate_5xx <= 20.5 THEN 6.0 ELSE 2.0 END "
            "+ CASE WHEN unique_ips <= 3.5 THEN 5.0 ELSE 3.0 END "
            "+ CASE WHEN top_path_ratio <= 0.4321 THEN 7.0 ELSE 2.5 END) / 3 "
            "/ (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)) AS anomaly_score "
            f"FROM {table}))")


def small_autoencoder():
    """One hidden unit that sums all inputs, and equal outputs."""
    n = len(FEATURE_COLUMNS)
    weights = np.array([0.05] * n + [0.1] + [0.3] * n + [-1.0] * n)
    return AE.AutoencoderModel([n, 1, n], "relu", weights, [0.0] * n, [100.0] * n, 0.5)


SMALL_AUTOENCODER = (
    "(SELECT *, anomaly_score > 0.5 AS is_anomaly FROM (SELECT *, "
    "list_avg([(v - y) * (v - y) for v in x]) AS anomaly_score FROM (SELECT *, "
    "1 / (1 + exp(1 - 0.3 * greatest(0.05 * list_sum(x) + 0.1, 0))) AS y FROM "
    "(SELECT *, [v / (100 + 1e-8) for v in features] AS x FROM vectors))))")
SCORES = ("SELECT source, window_id, timestamp, round(anomaly_score, 6) AS anomaly_score, "
          "is_anomaly FROM ")
#: The rows of every tree's sample, as its leaves count them.
TREE_ROWS = ("SELECT CAST(tree AS INTEGER) AS tree, least(256, n) AS sample_rows FROM "
             "range(100) t(tree), (SELECT count(*) AS n FROM features)")


def tree_rows(nodes):
    return nodes.groupBy("tree").agg(F.sum("size").alias("sample_rows"))


@query("iforest_fit", TREE_ROWS)
def _(spark, sf):
    """Rows in the leaves of each tree of a forest over all windows."""
    model = IF.iforest_fit(vectors(spark, sf), KEYS, stored=True)
    return tree_rows(spark.createDataFrame(model.nodes, IF.NODE_SCHEMA))


@query("iforest_score", SCORES + small_forest_sql("features"))
def _(spark, sf):
    return IF.iforest_score(vectors(spark, sf), small_forest()).drop("features")


@query("iforest_threshold",
       "SELECT round(quantile_cont(anomaly_score, 0.1), 6) AS threshold FROM scored")
def _(spark, sf):
    value = IF.forest_threshold(scored(spark, sf), "anomaly_score")
    return spark.createDataFrame([(value,)], "threshold double")


@query("exact_quantile",
       "SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS price_quantile FROM lineitem")
def _(spark, sf):
    """The narrowing method that large inputs take, on the largest table."""
    value = Q.exact_quantile(L.read_table(spark, sf, "lineitem"), "l_extendedprice", 0.95,
                             direct_rows=1000)
    return spark.createDataFrame([(value,)], "price_quantile double")


@query("ae_fit",
       "SELECT position, round(min(v), 6) AS low, round(max(v), 6) AS high, true AS improved FROM "
       "(SELECT CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS position, "
       "unnest(features) AS v FROM vectors) GROUP BY position")
def _(spark, sf):
    """Bounds of every input that a training over 20 epochs found, and whether its loss fell."""
    model = AE.ae_fit(vectors(spark, sf), KEYS, epochs=20)
    improved = len(model.losses) == 20 and model.losses[-1] < model.losses[0]
    rows = [(i, low, high, improved) for i, (low, high) in enumerate(zip(model.low, model.high))]
    return spark.createDataFrame(rows, "position int, low double, high double, improved boolean")


@query("ae_score", SCORES + SMALL_AUTOENCODER)
def _(spark, sf):
    return AE.ae_score(vectors(spark, sf), small_autoencoder()).drop("features")


@query("ae_threshold",
       "SELECT round(quantile_cont(anomaly_score, 0.95), 6) AS threshold FROM scored")
def _(spark, sf):
    value = AE.ae_threshold(scored(spark, sf), "anomaly_score")
    return spark.createDataFrame([(value,)], "threshold double")


BOTH_SCORES = " UNION ALL ".join(
    "SELECT source, window_id, timestamp, round(anomaly_score, 6) AS anomaly_score, is_anomaly, "
    f"'{kind}' AS model_type FROM {table}" for kind, table in
    (("isolation_forest", small_forest_sql("features")), ("autoencoder", SMALL_AUTOENCODER)))


@query("score_batch", BOTH_SCORES)
def _(spark, sf):
    """Scores of all windows by a model of either kind."""
    rows = vectors(spark, sf)
    return (M.score_batch(rows, small_forest())
            .unionByName(M.score_batch(rows, small_autoencoder())).drop("features"))


def _saved_forest(spark, sf):
    rows = K.with_vector(stored_features(spark, sf)).select(*KEYS, "features")
    path = scratch_path(spark, "model")
    M.model_save(spark, IF.iforest_fit(rows, KEYS, stored=True), path)
    return rows, path


@query("model_save", TREE_ROWS)
def _(spark, sf):
    """Rows in the leaves of each tree of the stored node table of a trained forest."""
    return tree_rows(M.saved_parameters(spark, _saved_forest(spark, sf)[1]))


@query("model_load", BOTH_SCORES)
def _(spark, sf):
    """Scores by models of either kind that were saved and loaded again."""
    rows, scores = vectors(spark, sf), []
    for model in (small_forest(), small_autoencoder()):
        path = scratch_path(spark, "model")
        M.model_save(spark, model, path)
        scores.append(M.score_batch(rows, M.model_load(spark, path)).drop("features"))
    return scores[0].unionByName(scores[1])


@query("retrain",
       "SELECT count(*) > 0 AS trained, 'isolation_forest' AS kind, least(256, count(*)) AS "
       "sample_size FROM (SELECT DISTINCT source, (epoch_us(timestamp) - t0) // 60000000 FROM "
       "(SELECT source, timestamp, min(epoch_us(timestamp)) OVER (PARTITION BY source) AS t0 "
       "FROM logs WHERE timestamp >= TIMESTAMP '2024-02-01' - INTERVAL 31 DAY "
       "AND timestamp <= TIMESTAMP '2024-02-01'))")
def _(spark, sf):
    """Whether a model was trained, its kind, and how many windows a tree of it saw."""
    path = scratch_path(spark, "model")
    done = T.retrain(L.logs(spark, sf), "2024-02-01 00:00:00", path, days_back=31)
    model = M.model_load(spark, path) if done else None
    row = (done, model.kind, model.sample_size) if model else (done, None, None)
    return spark.createDataFrame([row], "trained boolean, kind string, sample_size bigint")


@query("anomaly_summary",
       "SELECT count(*) FILTER (is_anomaly) AS count, count(*) AS total, "
       "round(count(*) FILTER (is_anomaly) / count(*) * 100, 6) AS percentage, "
       "bool_or(is_anomaly) AS has_anomaly FROM scored")
def _(spark, sf):
    return M.anomaly_summary(scored(spark, sf))


@query("anomaly_recent",
       "SELECT arg_max(anomaly_score, (timestamp, source)) AS score, "
       "arg_max(is_anomaly, (timestamp, source)) AS is_anomaly, "
       "round(avg(anomaly_score), 6) AS avg_score FROM scored")
def _(spark, sf):
    return M.anomaly_recent(scored(spark, sf))


CURVE_BLOCKS = {
    "labelled": "SELECT round(anomaly_score, 2) AS score, avg_response_time > 240 AS label, is_anomaly FROM scored",
    "curve": """
      SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, p, n,
        sum(p) OVER () AS positives, sum(n) OVER () AS negatives
      FROM (SELECT score, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM labelled GROUP BY score)
      WINDOW w AS (ORDER BY score DESC)""",
}


def _labelled(spark, sf):
    return scored(spark, sf).select(F.round("anomaly_score", 2).alias("anomaly_score"), "is_anomaly",
                                    (F.col("avg_response_time") > 240).alias("label"))


@query("threshold_curve",
       "SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(positives - tp AS BIGINT) AS fn, "
       "CAST(negatives - fp AS BIGINT) AS tn, round(tp / (tp + fp), 6) AS precision, "
       "round(tp / positives, 6) AS recall, round(2 * tp / (tp + fp + positives), 6) AS f1 FROM curve",
       **CURVE_BLOCKS)
def _(spark, sf):
    """Confusion counts at every threshold; many windows share a score."""
    return E.threshold_curve(_labelled(spark, sf)).drop("area")


@query("detector_evaluation",
       "SELECT f.*, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, "
       "round(2 * tp / (2 * tp + fp + fn), 6) AS f1, (SELECT round(sum(n * (2 * tp - p) / 2.0) / "
       "max(positives * negatives), 6) FROM curve) AS auc, "
       "(SELECT round(max(2 * tp / (tp + fp + positives)), 6) FROM curve) AS best_f1, "
       "(SELECT threshold FROM curve ORDER BY round(2 * tp / (tp + fp + positives), 12) DESC, threshold LIMIT 1) "
       "AS best_threshold FROM (SELECT count(*) FILTER (is_anomaly AND label) AS tp, "
       "count(*) FILTER (is_anomaly AND NOT label) AS fp, count(*) FILTER (NOT is_anomaly AND label) AS fn, "
       "count(*) FILTER (NOT is_anomaly AND NOT label) AS tn FROM labelled) f", **CURVE_BLOCKS)
def _(spark, sf):
    return E.detector_evaluation(_labelled(spark, sf))


@query("join_scores",
       "SELECT r.source, r.window_start, r.anomaly_score, r.is_anomaly, "
       "round(f.rps, 6) AS rps, f.unique_ips FROM scored r JOIN features f "
       "ON r.source = f.source AND r.window_start = f.timestamp")
def _(spark, sf):
    features = stored_features(spark, sf)
    results = scored(spark, sf, features).select(
        "source", "window_start", "anomaly_score", "is_anomaly")
    return T.join_scores(results, features).select(
        "source", "window_start", "anomaly_score", "is_anomaly", "rps", "unique_ips")


# --- similarity -------------------------------------------------------------------

FAILURES = "SELECT source, timestamp AS failure_time FROM features WHERE error_rate_5xx > 20"


def patterns_sql(minutes: int) -> str:
    return (f"SELECT f.source, f.failure_time, {minutes} AS minutes_before, "
            "flatten(list(v.features ORDER BY v.timestamp)) AS pattern "
            "FROM failures f JOIN vectors v ON v.source = f.source "
            f"AND v.timestamp >= f.failure_time - INTERVAL {minutes} MINUTE "
            "AND v.timestamp < f.failure_time GROUP BY f.source, f.failure_time")


def rolling_sql(minutes: int) -> str:
    return ("SELECT source, window_id, timestamp, flatten(list(features) OVER "
            "(PARTITION BY source ORDER BY timestamp RANGE BETWEEN "
            f"INTERVAL {minutes} MINUTE PRECEDING AND INTERVAL 1 SECOND PRECEDING)) AS pattern "
            "FROM vectors")


def _patterns(spark, sf, minutes=LOOK_BACK, features=None):
    if features is None:
        features = stored_features(spark, sf)
    return K.historical_failure_patterns(features, failures(features), minutes)


PATTERN_BLOCKS = {"failures": FAILURES, "patterns": patterns_sql(LOOK_BACK),
                  "rolling": rolling_sql(LOOK_BACK)}


@query("historical_failure_patterns",
       ELEMENTS.format(keys="source, failure_time, minutes_before", column="pattern",
                       table="patterns"), **PATTERN_BLOCKS)
def _(spark, sf):
    return elements(_patterns(spark, sf), ("source", "failure_time", "minutes_before"),
                    "pattern")


@query("add_failure_pattern",
       "SELECT source, minutes_before, len(pattern) AS length, count(*) AS pattern_count FROM "
       "(SELECT source, minutes_before, pattern FROM patterns UNION ALL "
       "SELECT source, 10, features FROM vectors) GROUP BY ALL", **PATTERN_BLOCKS)
def _(spark, sf):
    every = vectors(spark, sf).select("source", F.col("timestamp").alias("failure_time"),
                                      F.col("features").alias("pattern"))
    return (K.add_failure_pattern(every, existing=_patterns(spark, sf))
            .groupBy("source", "minutes_before", F.size("pattern").cast("bigint").alias("length"))
            .agg(F.count(F.lit(1)).alias("pattern_count")))


@query("pattern_flatten",
       ELEMENTS.format(keys="source, day", column="pattern", table="by_day"),
       by_day="SELECT source, CAST(timestamp AS DATE) AS day, "
              "flatten(list(features ORDER BY timestamp)) AS pattern FROM vectors GROUP BY ALL")
def _(spark, sf):
    by_day = (vectors(spark, sf).groupBy("source", F.to_date("timestamp").alias("day"))
              .agg(F.sort_array(F.collect_list(F.struct("timestamp", "features"))).alias("w")))
    return elements(by_day.withColumn("pattern", flatten_pattern(F.col("w.features"))),
                    ("source", "day"), "pattern")


@query("rolling_pattern",
       ELEMENTS.format(keys="source, window_id", column="pattern", table="rolling"),
       **PATTERN_BLOCKS)
def _(spark, sf):
    return elements(K.rolling_pattern(L.features(spark, sf), LOOK_BACK * 60), KEYS, "pattern")


def similarity_sql(queries: str, patterns: str, keys: str) -> str:
    return (f"SELECT {keys}, round(coalesce(max(s), 0), 6) AS similarity, "
            "coalesce(max(s) >= 0.8, false) AS is_risk FROM "
            f"(SELECT q.*, CASE WHEN p.pattern IS NULL THEN NULL "
            "WHEN list_sum([x * x for x in q.pattern]) = 0 "
            "OR list_sum([x * x for x in p.pattern]) = 0 THEN 0 "
            "ELSE list_cosine_similarity(q.pattern, p.pattern) END AS s "
            f"FROM (SELECT *, len(pattern) AS n FROM {queries}) q "
            f"LEFT JOIN (SELECT pattern, len(pattern) AS n FROM {patterns}) p USING (n)) "
            f"GROUP BY {keys}")


@query("failure_similarity", similarity_sql("rolling", "patterns", "source, window_id"),
       **PATTERN_BLOCKS)
def _(spark, sf):
    """Last four hours before every window against the four hours before each failure."""
    features = stored_features(spark, sf)
    found = K.failure_similarity(K.rolling_pattern(features, LOOK_BACK * 60),
                                 _patterns(spark, sf, features=features))
    return found.select(*KEYS, "similarity", "is_risk")


@query("failure_similarity_batch", similarity_sql("singles", "hourly", "source, window_id"),
       failures=FAILURES, hourly=patterns_sql(60),
       singles="SELECT source, window_id, features AS pattern FROM vectors")
def _(spark, sf):
    """Every single window against the hour before each failure."""
    features = stored_features(spark, sf)
    found = K.failure_similarity(K.with_vector(features), _patterns(spark, sf, 60, features),
                                 query_vector="features")
    return found.select(*KEYS, "similarity", "is_risk")


KNN = ("SELECT query_id, pattern_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM "
       "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, pattern_id) "
       "AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, "
       "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s "
       "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 5")


def _knn(spark, sf, **options):
    rows = L.read_table(spark, sf, "embeddings")
    return K.knn_topk(rows, rows, 5, "vec_id", "embedding", "vec_id", "embedding",
                      exclude_self=True, **options)


@query("knn_topk", KNN)
def _(spark, sf):
    return _knn(spark, sf)


@query("knn_topk_pivots", KNN)
def _(spark, sf):
    """The same where patterns are too many to hold: in tiles around centres (the pivots)."""
    return _knn(spark, sf, slice_bytes=100_000)


# --- alerts -----------------------------------------------------------------------

ALERT_OUT = "SELECT source, window_id, timestamp, alert_type, message, severity FROM "
LATEST_ALERTS = ("alerts WHERE (source, timestamp) IN "
                 "(SELECT (source, max(timestamp)) FROM features GROUP BY source)")


def _alert_query(name: str, kind: str):
    @query(name, ALERT_OUT + LATEST_ALERTS + f" AND alert_type = '{kind}'")
    def _(spark, sf):
        return A.alerts_all(scored(spark, sf), rules=(kind,), **ALERT_LIMITS).drop("value")


_alert_query("alert_error_rate", "error_rate")
_alert_query("alert_response_time", "response_time")
_alert_query("alert_anomaly", "anomaly")


@query("alerts_all", ALERT_OUT + LATEST_ALERTS)
def _(spark, sf):
    return A.alerts_all(scored(spark, sf), **ALERT_LIMITS).drop("value")


@query("alerts_every_window", ALERT_OUT + "alerts")
def _(spark, sf):
    return alerts(spark, sf).drop("value")


@query("latest_window",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM features WHERE "
       "(source, timestamp) IN (SELECT (source, max(timestamp)) FROM features GROUP BY source)")
def _(spark, sf):
    return _doubles(A.latest_window(L.features(spark, sf)))


@query("alert_retention", ALERT_OUT + f"alerts {ALERT_ORDER} LIMIT 50")
def _(spark, sf):
    return A.alert_retention(alerts(spark, sf)).drop("value")


@query("alerts_recent",
       "SELECT source, window_id, timestamp, alert_type, message, severity, "
       f"(SELECT count(*) FROM alerts) AS total_count FROM alerts {ALERT_ORDER} LIMIT 5")
def _(spark, sf):
    return A.alerts_recent(alerts(spark, sf, stored_features(spark, sf))).drop("value")


@query("alert_count_by_type",
       "SELECT alert_type, count(*) AS alert_count FROM alerts GROUP BY alert_type")
def _(spark, sf):
    return A.alert_count_by_type(alerts(spark, sf))


# --- reports ----------------------------------------------------------------------

@query("db_statistics",
       "SELECT (SELECT count(*) FROM logs) AS total_logs, (SELECT max(timestamp) FROM logs) "
       "AS latest_log_time, (SELECT count(*) FROM features) AS total_features, "
       "(SELECT max(timestamp) FROM features) AS latest_feature_time, (SELECT count(*) "
       "FROM scored) AS total_anomaly_results, (SELECT count(*) FROM alerts) AS total_alerts")
def _(spark, sf):
    features = stored_features(spark, sf)
    return R.db_statistics(L.logs(spark, sf), features, scored(spark, sf, features),
                           alerts(spark, sf, features))


LAST_LOGS = "(SELECT * FROM logs ORDER BY timestamp DESC, log_id DESC LIMIT {})"


@query("recent_error_rate",
       "SELECT round(count(*) FILTER (status_code >= 500) / count(*) * 100, 6) AS error_rate "
       "FROM " + LAST_LOGS.format(100))
def _(spark, sf):
    return R.recent_error_rate(L.logs(spark, sf))


@query("recent_anomaly_alerts",
       "SELECT count(*) FILTER (alert_type = 'anomaly') AS recent_anomalies FROM "
       f"(SELECT * FROM alerts {ALERT_ORDER} LIMIT 10)")
def _(spark, sf):
    return A.recent_anomaly_alerts(alerts(spark, sf))


@query("dashboard_metrics",
       "SELECT (SELECT count(*) FROM logs) AS total_logs, (SELECT round(count(*) FILTER (ok) "
       "/ count(*) * 100, 6) FROM parsed) AS success_rate, (SELECT count(*) FROM alerts "
       "WHERE alert_type = 'anomaly') AS anomaly_count, (SELECT count(*) FROM features) "
       "AS window_count, (SELECT round(count(*) FILTER (status_code >= 500) / count(*) * 100, 6) "
       "FROM " + LAST_LOGS.format(100) + ") AS error_rate")
def _(spark, sf):
    """The log is parsed once, and everything else starts from the columns that were kept."""
    parsed = materialize(W.window_inputs(L.parsed(spark, sf), "log_id", "parse_ok"), "dashboard")[0]
    features = materialize(W.window_features(P.parsed_only(parsed), L.HOUR, stored=True), "features")[0]
    return R.dashboard_metrics(parsed, features, alerts(spark, sf, features))


@query("status_summary",
       "SELECT count(*) FILTER (status_code IN (200, 201)) AS success, count(*) FILTER "
       "(status_code IN (400, 404)) AS client_errors, count(*) FILTER (status_code IN "
       "(500, 502, 503)) AS server_errors FROM " + LAST_LOGS.format(20))
def _(spark, sf):
    return R.status_summary(L.logs(spark, sf))


@query("status_counts",
       "SELECT status_code, count(*) AS log_count FROM logs GROUP BY status_code")
def _(spark, sf):
    return R.status_counts(L.logs(spark, sf))


@query("recent_logs", "SELECT log_id, timestamp, ip, status_code FROM " + LAST_LOGS.format(20))
def _(spark, sf):
    return R.recent_logs(L.logs(spark, sf)).select("log_id", "timestamp", "ip", "status_code")


@query("recent_features",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM features "
       "ORDER BY timestamp DESC, source DESC LIMIT 10")
def _(spark, sf):
    return _doubles(R.recent_features(L.features(spark, sf)))


def _series_query(name: str, column: str):
    @query(name, f"SELECT source, timestamp, {rounded([column])} FROM features")
    def _(spark, sf):
        return R.series(L.features(spark, sf), column)


_series_query("series_rps", "rps")
_series_query("series_error_rate", "error_rate_5xx")
_series_query("series_response_time", "avg_response_time")


@query("series_anomaly",
       "SELECT source, timestamp, anomaly_score, is_anomaly, CAST(0.75 AS DOUBLE) AS threshold "
       "FROM scored")
def _(spark, sf):
    return R.series_anomaly(scored(spark, sf), 0.75)


@query("report",
       f"SELECT '2024-01-20T12:00:00.000000' AS timestamp, (SELECT count(*) FROM logs) AS total_logs, "
       "(SELECT count(*) FROM features) AS total_windows, (SELECT count(*) FROM alerts) "
       "AS total_alerts, (SELECT count(*) FROM alerts WHERE alert_type = 'anomaly') "
       "AS anomaly_count, 'None' AS model")
def _(spark, sf):
    features = stored_features(spark, sf)
    made = R.report(L.logs(spark, sf), features, alerts(spark, sf, features), as_of=AS_OF)
    def part(path, kind="bigint"):
        return F.get_json_object("report", f"$.{path}").cast(kind).alias(path.split(".")[-1])
    return made.select(
        part("timestamp", "string"), part("statistics.total_logs"),
        part("statistics.total_windows"), part("statistics.total_alerts"),
        part("statistics.anomaly_count"), part("model", "string"))


# --- history ----------------------------------------------------------------------

@query("merge_features",
       "SELECT source, window_id, timestamp, round(rps, 6) AS rps FROM (SELECT source, window_id, "
       f"timestamp, CASE WHEN timestamp <= TIMESTAMP '{END}' THEN rps ELSE rps / 60 END AS rps "
       f"FROM features) ORDER BY timestamp DESC, source DESC LIMIT 100")
def _(spark, sf):
    """Two overlapping runs that differ in the divisor of the request rate."""
    columns = (*KEYS, "timestamp", "rps")
    first = sources.time_range(L.features(spark, sf), None, END).select(*columns)
    second = sources.time_range(L.features(spark, sf, rps_seconds=3600), START, None)
    return H.merge_features(first, second.select(*columns), keep=100)


@query("cap_recent",
       "SELECT log_id, source, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY source "
       "ORDER BY timestamp DESC, log_id DESC) AS r FROM logs) WHERE r <= 1000")
def _(spark, sf):
    return H.cap_recent(L.logs(spark, sf), 1000, "source").select(
        "log_id", "source", "timestamp")


@query("recent_input",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM features",
       logs="SELECT * EXCLUDE (ok) FROM parsed WHERE ok ORDER BY timestamp DESC, log_id DESC "
            "LIMIT 100")
def _(spark, sf):
    return _doubles(L.features(spark, sf, max_logs=100))


# --- streaming --------------------------------------------------------------------

WATERMARK = "1 hour"
EPOCH_BLOCKS = {
    "anchored": "SELECT *, epoch_us(timestamp) // 3600000000 AS window_id, "
                "TIMESTAMP '1970-01-01' AS t0 FROM logs",
    "closed": "SELECT * FROM features WHERE timestamp + INTERVAL 1 HOUR <= "
              "(SELECT max(timestamp) FROM logs) - INTERVAL 1 HOUR",
}


def _log_stream(spark, sf):
    return P.parsed_only(sources.read_log_stream(
        spark, log_files(spark, sf), source=folder_source(), on_bad_time="reject"))


def _run_pipeline(spark, stream, **options):
    out = scratch_path(spark, "pipeline")
    query = start_pipeline(stream, out, scratch_path(spark, "pipeline-check"), L.HOUR,
                           WATERMARK, **options)
    query.awaitTermination()
    return out, query


@query("stream_parse", STREAMED)
def _(spark, sf):
    lines = spark.readStream.schema("value string").text(log_files(spark, sf))
    stream = P.parse_access_log(lines.select(folder_source().alias("source"), "value"),
                                on_bad_time="reject")
    return _stream_to_table(spark, stream.select(
        "source", "raw_line", "timestamp", "status_code", "url_path", "parse_ok"))


STATIC_FEATURES = tuple(c for c in FEATURE_COLUMNS if not c.endswith("_change"))


@query("stream_window_features",
       f"SELECT source, window_id, timestamp, {rounded(STATIC_FEATURES)} FROM closed",
       **EPOCH_BLOCKS)
def _(spark, sf):
    stream = closed_windows(_log_stream(spark, sf), L.HOUR, WATERMARK)
    return _doubles(_stream_to_table(spark, stream).select(
        *KEYS, "timestamp", *STATIC_FEATURES))


@query("stream_change_rates",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM closed",
       **EPOCH_BLOCKS)
def _(spark, sf):
    out, _ = _run_pipeline(spark, _log_stream(spark, sf))
    return _doubles(read_batches(spark, out, "features").drop("batch_id"))


@query("stream_callback",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM closed",
       **EPOCH_BLOCKS)
def _(spark, sf):
    """What a callback of the pipeline is given, batch by batch, in a table of its own."""
    given = scratch_path(spark, "callback")
    _run_pipeline(spark, _log_stream(spark, sf), callbacks=(
        lambda features, batch: features.write.parquet(f"{given}/batch_id={batch}"),))
    return _doubles(spark.read.parquet(given).drop("batch_id"))


@query("stream_detect",
       SCORES.removesuffix(" FROM ") + ", 'isolation_forest' AS model_type FROM "
       + small_forest_sql("closed"), **EPOCH_BLOCKS)
def _(spark, sf):
    """Every closed window scored by a forest."""
    out, _ = _run_pipeline(spark, _log_stream(spark, sf), model=small_forest())
    return read_batches(spark, out, "anomaly_results").drop("batch_id")


@query("stream_alerts",
       "SELECT source, window_id, timestamp, alert_type, message, severity FROM alerts "
       "WHERE alert_type <> 'anomaly'",
       **EPOCH_BLOCKS, scored=BLOCKS["scored"].replace("FROM features", "FROM closed"))
def _(spark, sf):
    out, _ = _run_pipeline(spark, _log_stream(spark, sf), thresholds=ALERT_LIMITS)
    return read_batches(spark, out, "alerts").drop("batch_id", "value")


@query("stream_parse_stats",
       "SELECT count(*) FILTER (ok) AS parsed_count, count(*) FILTER (NOT ok) AS error_count, "
       "count(*) AS total_count FROM parsed")
def _(spark, sf):
    out = scratch_path(spark, "stats")
    stream = sources.read_log_stream(
        spark, log_files(spark, sf), source=folder_source(), on_bad_time="reject")
    store_parse_stats(stream, out, scratch_path(spark, "stats-check")).awaitTermination()
    return stored_parse_stats(spark, out).agg(*[
        F.sum(n).alias(n) for n in ("parsed_count", "error_count", "total_count")])


@query("late_data",
       "SELECT source, window_id, total_requests FROM closed", **EPOCH_BLOCKS)
def _(spark, sf):
    """The log, then, in a later micro-batch, all of it again: too late for closed windows."""
    path = log_files(spark, sf)
    out, check = scratch_path(spark, "late"), scratch_path(spark, "late-check")

    def run():
        stream = P.parsed_only(sources.read_log_stream(
            spark, path, source=folder_source(), on_bad_time="reject"))
        start_pipeline(stream, out, check, L.HOUR, WATERMARK).awaitTermination()

    run()
    (L.lines(spark, sf).select("source", "value").write.mode("append")
     .partitionBy("source").text(path))
    run()
    return read_batches(spark, out, "features").select(*KEYS, "total_requests")


@query("late_data_corrected",
       f"SELECT source, window_id, timestamp, {rounded(FEATURE_COLUMNS)} FROM closed",
       **EPOCH_BLOCKS)
def _(spark, sf):
    """The later half of the log first, then the earlier, all of it late: nothing is lost."""
    path = scratch_path(spark, "late-log")
    out, check = scratch_path(spark, "late"), scratch_path(spark, "late-check")
    lines = L.lines(spark, sf)
    half = lines.agg(F.expr("(min(log_id) + max(log_id)) div 2").alias("half")).first()["half"]
    for some in (lines.filter((F.col("log_id") > half) | (F.col("log_id") % 7 == 0)),
                 lines.filter((F.col("log_id") <= half) & (F.col("log_id") % 7 != 0))):
        some.select("source", "value").write.mode("append").partitionBy("source").text(path)
        stream = P.parsed_only(sources.read_log_stream(
            spark, path, source=folder_source(), on_bad_time="reject"))
        start_pipeline(stream, out, check, L.HOUR, WATERMARK, late="correct").awaitTermination()
    return _doubles(newest(read_batches(spark, out, "features")).drop("batch_id"))


STREAM_TABLE = ("rps", "error_rate_5xx", "avg_response_time", "max_response_time", "unique_ips")


@query("stream_tables",
       f"SELECT source, timestamp, {rounded(STREAM_TABLE)} FROM closed WHERE {RANGE} "
       "ORDER BY timestamp DESC, source DESC LIMIT 1000", **EPOCH_BLOCKS)
def _(spark, sf):
    """Features that a stream appended in two runs, the first of them compacted, as scanned."""
    path, tables = scratch_path(spark, "tables-log"), scratch_path(spark, "tables")
    out, check = scratch_path(spark, "tables-out"), scratch_path(spark, "tables-check")
    lines = L.lines(spark, sf)
    half = lines.agg(F.expr("(min(log_id) + max(log_id)) div 2").alias("half")).first()["half"]
    for some in (lines.filter(F.col("log_id") <= half), lines.filter(F.col("log_id") > half)):
        some.select("source", "value").write.mode("append").partitionBy("source").text(path)
        stream = P.parsed_only(sources.read_log_stream(
            spark, path, source=folder_source(), on_bad_time="reject"))
        sinks.compact(spark, f"{tables}/features")
        start_pipeline(stream, out, check, L.HOUR, WATERMARK, tables=tables).awaitTermination()
    found = sources.scan_features(sinks.streamed_table(spark, f"{tables}/features"), START, END)
    return found.select("source", "timestamp", *[F.col(c).cast("double").alias(c) for c in STREAM_TABLE])
