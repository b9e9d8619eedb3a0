"""Reading raw logs, as batch or stream, and the stored tables."""

from .log_text import clean_lines, read_lines, read_log_batch, read_log_stream, source_of_path
from .tables import (
    scan_alerts, scan_anomaly_results, scan_features, scan_logs, scan_recent_days, scan_rejects,
    time_range,
)

__all__ = [
    "clean_lines", "read_lines", "read_log_batch", "read_log_stream", "scan_alerts",
    "scan_anomaly_results", "scan_features", "scan_logs", "scan_recent_days", "scan_rejects",
    "source_of_path", "time_range",
]
