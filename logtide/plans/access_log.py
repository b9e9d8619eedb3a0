"""The access log that the queries run on, derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.parse import parse_access_log, parsed_only
from ..operators.windows import window_features
from ..session import spread

# One-minute windows of this log are mostly empty; hours hold a useful number of rows.
HOUR = 3600


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log_lines(events: DataFrame) -> DataFrame:
    """``(log_id, source, value)``: one combined-format line with response time per event.

    Every 97th line has ``-`` for its byte count and so does not parse.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.when(k < 50, 500).when(k < 75, 404).when(k < 90, 503).otherwise(400)
    status = (F.when(F.col("event_type") == "error", error)
              .when(F.col("event_type") == "signup", 201).otherwise(200))
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    size = F.when(F.col("event_id") % 97 == 0, F.lit("-")).otherwise(
        (F.lit(100) + (F.col("event_id") * 37) % 5000).cast("string"))
    text = F.concat(
        F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256,
        F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'),
        method, F.lit(" /"), F.col("event_type"), F.lit("/"), k % 10, F.lit("?k="), k,
        F.lit(' HTTP/1.1" '), status, F.lit(" "), size,
        F.lit(' "-" "Mozilla/5.0 (X11)" '), F.col("value").cast("string"))
    return events.select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("site"), (F.col("user_id") % 3).cast("string")).alias("source"),
        text.alias("value"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_lines(spread(read_table(spark, sf_dir, "events")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_access_log(lines(spark, sf_dir), on_bad_time="reject")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_only(parsed(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return window_features(logs(spark, sf_dir), window_seconds=HOUR, **options)
