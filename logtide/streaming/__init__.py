"""Structured Streaming versions of parsing, windows, detection and alerts."""

from .late import current_rows, newest
from .pipeline import start_pipeline
from .tables import read_batches
from .windows import (
    closed_windows, observe_parse_stats, store_parse_stats, stored_parse_stats,
)

__all__ = ["closed_windows", "current_rows", "newest", "observe_parse_stats", "read_batches",
           "start_pipeline", "store_parse_stats", "stored_parse_stats"]
