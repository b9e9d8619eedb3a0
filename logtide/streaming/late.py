"""A stream whose windows take in rows however late they come.

Every micro-batch is reduced to partial counts per window, client and path, which are stored.
A window is published when the watermark has passed it, and again, as a newer version, whenever
rows for it arrive after that: its partial counts of all micro-batches are merged once more.
So no row is lost, and the newest versions are what the batch operator makes of all rows in any
order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import WINDOW_SECONDS
from ..operators.windows import (
    MICROS, assign_windows, change_rates, features_of_counts, merged_counts, window_partials,
)
from ..sources.tables import utc_date
from .tables import batch_path, read_batches

KEYS = ("source", "window_id")
#: Days before a corrected window in which the one before it is looked for first.
NEAR_DAYS = 2


def newest(table: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of all versions of a row the one of the latest micro-batch.

    Versions are put side by side by an aggregate that combines before its shuffle.
    """
    columns = [c for c in table.columns if c not in keys]
    return (table.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("_v"))
            .select(*keys, "_v.*"))


def current_rows(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Of a table that goes with the windows (scores, alerts, outbox) what was published with
    their newest version: an alert that a correction took back is not among them."""
    version = features.groupBy(*KEYS).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(version, [*KEYS, "batch_id"], "left_semi")


def _written(spark: SparkSession, out: str, table: str, upto: int) -> DataFrame | None:
    """A table as micro-batches up to ``upto`` left it, none before the first."""
    if upto < 0:
        return None
    return read_batches(spark, out, table).filter(F.col("batch_id") <= upto)


class LateWindows:
    """What a micro-batch of parsed rows does to the stored windows."""

    def __init__(self, out: str, window_seconds: int = WINDOW_SECONDS, watermark: str = "10 minutes",
                 rps_seconds: int = WINDOW_SECONDS):
        self.out, self.width, self.rps_seconds = out, window_seconds * MICROS, rps_seconds
        self.window_seconds, self.delay = window_seconds, F.expr(f"interval {watermark}")

    def _horizon(self, spark: SparkSession, batch_id: int):
        """Latest time of the rows up to a micro-batch; none before the first row."""
        if batch_id < 0:
            return None
        try:
            return spark.read.parquet(batch_path(self.out, "clock", batch_id)).first()["latest"]
        except AnalysisException as error:
            raise RuntimeError(f"the clock of batch {batch_id} is missing in {self.out}") from error

    def _closed(self, latest) -> Column:
        """Windows that the watermark has passed when ``latest`` was the latest time."""
        end = F.timestamp_micros((F.col("window_id") + 1) * F.lit(self.width))
        return end <= F.lit(latest) - self.delay if latest is not None else F.lit(False)

    def _day(self) -> Column:
        return utc_date(F.timestamp_micros(F.col("window_id") * F.lit(self.width)))

    def take(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Store the partial counts of ``rows``; returns the windows to publish, without their
        change rates, all rows of all micro-batches counted."""
        spark, keys = rows.sparkSession, [*KEYS]
        before = self._horizon(spark, batch_id - 1)
        partial = window_partials(assign_windows(rows, self.window_seconds, "epoch"), keys)
        latest = rows.agg(F.max("timestamp").alias("latest"))
        (partial.withColumn("event_date", self._day())
         .write.mode("overwrite").partitionBy("event_date")
         .parquet(batch_path(self.out, "partials", batch_id)))
        previous = F.lit(before).cast("timestamp")
        (latest.select(F.greatest(F.col("latest"), previous).alias("latest")).coalesce(1)
         .write.mode("overwrite").parquet(batch_path(self.out, "clock", batch_id)))
        now = self._horizon(spark, batch_id)
        stored = _written(spark, self.out, "partials", batch_id)
        # What closes now, and what was closed and has new rows; days prune what is read.
        due = (stored.filter(self._closed(now) & (~self._closed(before) | (F.col("batch_id") == batch_id)))
               .select(*keys, "event_date").distinct())
        days = [r[0] for r in due.select("event_date").distinct().collect()]
        counted = (stored.filter(F.col("event_date").isin(days))
                   .join(due, [*keys, "event_date"], "left_semi")) if days else stored.limit(0)
        start = F.timestamp_micros(F.col("window_id") * F.lit(self.width))
        return features_of_counts(
            merged_counts(counted, keys), ["source", "window_id", start.alias("timestamp")],
            self.rps_seconds, "response_time" in rows.columns, "method" in rows.columns)

    def with_change_rates(self, windows: DataFrame, batch_id: int) -> DataFrame:
        """``windows`` (stored) with change rates, and the windows after them brought up to date.

        A window is compared with the one before it, so a correction also changes the next. Both
        are looked for in the days around first; sources that have none there are
        looked up in all days.
        """
        spark = windows.sparkSession
        earlier = _written(spark, self.out, "features", batch_id - 1)
        new = windows.withColumn("_new", F.lit(True))
        if earlier is None:
            return change_rates(new).drop("_new")
        earlier = newest(earlier).drop("batch_id")
        old = earlier.join(windows.select(*KEYS), [*KEYS], "left_anti")
        bounds = windows.groupBy("source").agg(F.min("window_id").alias("_lo"))
        per_day = 86_400 * MICROS // self.width + 1
        near = (old.join(bounds, "source")
                .filter(F.col("window_id") >= F.col("_lo") - NEAR_DAYS * per_day).drop("_lo"))
        has_one = (near.join(bounds, "source").filter(F.col("window_id") < F.col("_lo"))
                   .select("source").distinct())
        far = (old.join(bounds.join(has_one, "source", "left_anti"), "source")
               .filter(F.col("window_id") < F.col("_lo")).groupBy("source")
               .agg(F.max_by(F.struct(*old.columns), "window_id").alias("_w")).select("_w.*"))
        around = near.unionByName(far).select(*windows.columns).withColumn("_new", F.lit(False))
        both = change_rates(new.unionByName(around))
        link = Window.partitionBy("source").orderBy("window_id")
        # Only windows of the days around, and their flags, meet in one place per source.
        after = both.select(*KEYS, "_new").withColumn("_after", F.lag("_new").over(link))
        wanted = after.filter("_new or _after").select(*KEYS)
        return both.join(wanted, [*KEYS], "left_semi").drop("_new")

