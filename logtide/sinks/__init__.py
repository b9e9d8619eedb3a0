"""Stored tables, exports and the alert outbox."""

from .exports import export_alerts_json, export_features_csv, export_logs_csv
from .outbox import alert_outbox, write_outbox
from .streamed import append_batch, compact, stream_logs, streamed_table
from .tables import (
    alerts_table, anomaly_results_table, features_table, logs_table, write_alerts,
    rejects_table, write_anomaly_results, write_features, write_logs, write_rejects, write_table,
)

__all__ = [
    "alert_outbox", "alerts_table", "anomaly_results_table", "append_batch", "compact",
    "export_alerts_json", "export_features_csv", "export_logs_csv", "features_table", "logs_table",
    "rejects_table", "stream_logs", "streamed_table", "write_alerts", "write_anomaly_results",
    "write_features", "write_logs", "write_outbox", "write_rejects", "write_table",
]
