"""Window features of a stream of parsed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import WINDOW_SECONDS
from ..operators.parse import parse_stats
from ..operators.windows import MICROS, features_of_counts, window_counts
from .tables import read_batches, write_batch


def observe_parse_stats(parsed: DataFrame, name: str | Observation = "parse_stats") -> DataFrame:
    """Count parsed and failed lines of every micro-batch as they pass.

    The counts come with the progress of the query, under ``observedMetrics``, of which Spark keeps
    the latest hundred; ``store_parse_stats`` keeps all.
    """
    return parsed.observe(name, F.count_if("parse_ok").alias("parsed_count"),
                          F.count_if(~F.col("parse_ok")).alias("error_count"),
                          F.count(F.lit(1)).alias("total_count"))


def store_parse_stats(parsed: DataFrame, out: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Write the counts of every micro-batch, by source; one that is run again replaces its own."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(parse_stats(batch).drop("success_rate"), out, "parse_stats", batch_id)

    return (parsed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stored_parse_stats(spark: SparkSession, out: str) -> DataFrame:
    """Parsed, failed and total lines by source over all micro-batches, and the success rate."""
    counts = read_batches(spark, out, "parse_stats").groupBy("source").agg(
        *[F.sum(c).alias(c) for c in ("parsed_count", "error_count", "total_count")])
    return counts.withColumn("success_rate", F.coalesce(
        F.try_divide(F.col("parsed_count"), F.col("total_count")) * 100, F.lit(0.0)))


def closed_windows(logs: DataFrame, window_seconds: int = WINDOW_SECONDS,
                   watermark: str = "10 minutes", rps_seconds: int = WINDOW_SECONDS
                   ) -> DataFrame:
    """Features, without change rates, of every window the watermark has passed.

    Windows are aligned to the epoch. The two chained aggregations are those of the batch
    operator; their state holds one row per client and path of the windows still open.
    Rows later than the watermark are dropped and counted by the query.
    """
    rows = (logs.withWatermark("timestamp", watermark)
            .withColumn("window", F.window("timestamp", f"{window_seconds} seconds")))
    counts = window_counts(rows, ["source", "window"])
    start = F.col("window.start")
    width = window_seconds * MICROS
    features = features_of_counts(
        counts, ["source", start.alias("timestamp"),
                 F.expr(f"(unix_micros(window.start) - pmod(unix_micros(window.start), {width}L))"
                        f" div {width}L").alias("window_id")],
        rps_seconds, "response_time" in logs.columns, "method" in logs.columns)
    return features
