"""Column-level building blocks: everything here takes and returns Columns."""

from .log_line import (
    log_time, null_dash, response_time_of_line, split_line, status_class, url_path,
)
from .text import drop_undecodable, fixed_decimals, strip_blanks
from .vectors import cosine_similarity, feature_vector, flatten_pattern

__all__ = [
    "cosine_similarity", "drop_undecodable", "feature_vector", "fixed_decimals",
    "flatten_pattern", "log_time", "null_dash", "response_time_of_line", "split_line",
    "status_class", "strip_blanks", "url_path",
]
