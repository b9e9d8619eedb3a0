"""The whole stream: closed windows, change rates, scores, alerts, stored per micro-batch.

Everything a micro-batch writes goes to its own ``batch_id`` folder and replaces it, so a
batch that is run again after a failure leaves each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import CHANGE_COLUMNS, FEATURE_COLUMNS, WINDOW_SECONDS
from ..operators.alerts import alerts_every_window, latest_window
from ..operators.models import Model, score_batch
from ..operators.similarity import with_vector
from ..operators.windows import change_rates
from ..sinks.outbox import alert_outbox
from ..sinks.streamed import append_batch
from ..sinks.tables import alerts_table, anomaly_results_table, features_table
from .late import LateWindows
from .tables import batch_path, write_batch
from .windows import closed_windows

_STATE_COLUMNS = ("source", "window_id", "timestamp", *CHANGE_COLUMNS)


def _state_before(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Last window of every source as of the batch before this one.

    Every batch writes its state, so the one before is complete when this one starts; if it
    is missing, changes would be taken from nothing, so that is an error.
    """
    if batch_id == 0:
        return None
    try:
        return spark.read.parquet(batch_path(out, "last_windows", batch_id - 1))
    except AnalysisException as error:
        raise RuntimeError(f"the state of batch {batch_id - 1} is missing in {out}") from error


def with_change_rates(windows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Change rates of newly closed windows, linked to the stored last ones."""
    both = windows.withColumn("_new", F.lit(True))
    if before is not None:
        both = both.unionByName(before.withColumn("_new", F.lit(False)),
                                allowMissingColumns=True)
    return change_rates(both).filter("_new").drop("_new")


def start_pipeline(logs: DataFrame, out: str, checkpoint: str,
                   window_seconds: int = WINDOW_SECONDS, watermark: str = "10 minutes",
                   rps_seconds: int = WINDOW_SECONDS, model: Model | None = None,
                   thresholds: Mapping[str, float] | None = None, channels=(),
                   trigger: Mapping | None = None,
                   callbacks: tuple[Callable[[DataFrame, int], None], ...] = (),
                   late: str = "drop", tables: str | None = None) -> StreamingQuery:
    """Start the query that turns parsed log rows into stored features, scores and alerts.

    ``logs`` is a stream of parsed rows. With a ``model`` every closed window is scored;
    alerts are raised once per window. ``callbacks`` get the features of each micro-batch.
    ``trigger`` is passed to Spark, e.g. ``{'processingTime': '10 seconds'}``.

    Rows later than the watermark are dropped and counted by default. With ``late='correct'``
    they are merged into their windows, which are published again: ``late.newest`` of a
    table has the last version of each window, ``late.current_rows`` the alerts that still hold.

    ``tables`` is a folder with the day-partitioned tables ``features``, ``anomaly_results`` and
    ``alerts`` to which everything is appended as well, for ``sinks.streamed_table``, scans and
    compaction. Windows are published once there, so it goes with ``late='drop'``.
    """
    if tables and late != "drop":
        raise ValueError("tables hold every window once, so rows must not be corrected")
    if late not in ("drop", "correct"):
        raise ValueError(f"late must be 'drop' or 'correct', not {late!r}")
    limits = dict(thresholds or {})

    def stored(df: DataFrame, table: str, batch_id: int) -> DataFrame:
        # Written first and read back: everything after it starts from the stored rows.
        write_batch(df, out, table, batch_id)
        return df.sparkSession.read.schema(df.schema).parquet(batch_path(out, table, batch_id))

    def publish(features: DataFrame, batch_id: int) -> DataFrame:
        """Store features and all that follows from them."""
        features = stored(features.select("source", "window_id", "timestamp", *[
            c for c in FEATURE_COLUMNS if c in features.columns]), "features", batch_id)
        scored = features
        if model is not None:
            scores = score_batch(with_vector(features), model).drop("features").select(
                "source", "window_id", "timestamp", "anomaly_score", "is_anomaly", "model_type")
            scores = stored(scores, "anomaly_results", batch_id)
            scored = features.join(scores.select("source", "window_id", "anomaly_score", "is_anomaly"),
                                   ["source", "window_id"], "left")
        alerts = stored(alerts_every_window(scored, **limits), "alerts", batch_id)
        if tables:
            append_batch(features_table(features), f"{tables}/features", batch_id)
            append_batch(alerts_table(alerts), f"{tables}/alerts", batch_id)
            if model is not None:
                append_batch(anomaly_results_table(scores), f"{tables}/anomaly_results", batch_id)
        if channels:
            write_batch(alert_outbox(alerts, channels), out, "outbox", batch_id)
        for callback in callbacks:
            callback(features, batch_id)
        return features

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = _state_before(batch.sparkSession, out, batch_id)
        features = publish(with_change_rates(batch, before), batch_id)
        state = features.select(*_STATE_COLUMNS)
        if before is not None:
            state = state.unionByName(before)
        write_batch(latest_window(state, "window_id"), out, "last_windows", batch_id)

    corrected = LateWindows(out, window_seconds, watermark, rps_seconds)

    def merge(batch: DataFrame, batch_id: int) -> None:
        due = stored(corrected.take(batch, batch_id), "due", batch_id)
        publish(corrected.with_change_rates(due, batch_id), batch_id)

    rows = logs if late == "correct" else closed_windows(logs, window_seconds, watermark, rps_seconds)
    writer = (rows.writeStream.outputMode("append").foreachBatch(merge if late == "correct" else handle)
              .option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
