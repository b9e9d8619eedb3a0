"""Expressions that take one access-log line apart.

The line pattern is the expensive part of any job on raw logs, so it runs once per line:
``split_line`` rewrites a matching line to its fields joined by a separator and splits
that, where one ``regexp_extract`` per field would match the line ten times.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (
    COMBINED_LINE, COMMON_LINE, LINE_FIELDS, LOG_TIME_FORMATS, RESPONSE_TIME_MIN_TOKENS,
)

_SEP = "\u0001"
_EDGE = "\u0002"
# Fields plus the unmatched rest of the line.
SPLIT_SIZE = len(LINE_FIELDS) + 1


def _fields(line: Column, pattern: str, groups: int) -> Column:
    """Rewrite a matching line to its fields joined by a separator, and split there."""
    whole = rf"(?U)^\s*+{pattern}((?s:.*+))"
    parts = [f"${i}" for i in range(1, groups + 1)]
    parts += ["-"] * (len(LINE_FIELDS) - groups) + [f"${groups + 1}"]
    usual = F.split(F.regexp_replace(line, whole, _SEP.join(parts)), _SEP, -1)
    # A line with the separator in it gets a longer one that it cannot contain: a run of
    # more separator characters than the line has characters, closed at both ends.
    longer = F.concat(F.lit(_EDGE), F.repeat(F.lit(_SEP), F.length(line) + 1), F.lit(_EDGE))
    joined = F.concat_ws("", *[x for part in parts[:-1] for x in (F.lit(part), longer)],
                         F.lit(parts[-1]))
    special = F.split(F.regexp_replace(line, F.lit(whole), joined), longer, -1)
    return F.when(line.contains(_SEP), special).otherwise(usual)


def split_line(line: Column, is_common: Column | bool = False,
               pattern: str | None = None) -> Column:
    """The fields of a line and its rest as an array; one element if it does not match.

    ``pattern`` replaces the built-in one; it must capture the same ten fields in order.
    """
    if pattern is not None:
        return _fields(line, pattern, len(LINE_FIELDS))
    if is_common is True:
        return _fields(line, COMMON_LINE, 8)
    if is_common is False:
        return _fields(line, COMBINED_LINE, 10)
    return F.when(is_common, _fields(line, COMMON_LINE, 8)).otherwise(
        _fields(line, COMBINED_LINE, 10))


def log_time(text: Column) -> Column:
    """Bracketed time with offset to an instant; null if it is not a valid time."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in LOG_TIME_FORMATS])


def url_path(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def null_dash(field: Column) -> Column:
    return F.nullif(field, F.lit("-"))


def response_time_of_line(line: Column) -> Column:
    """Last token of the line if it is a number and enough tokens come before it."""
    found = F.regexp_extract(
        line,
        rf"(?U)^\s*+(?:\S++\s++){{{RESPONSE_TIME_MIN_TOKENS}}}(?s:.*(?<!\S))([0-9.]++)\s*+\z",
        1)
    return found.try_cast("double")


def response_time_of_rest(rest: Column) -> Column:
    """The same on what follows a combined line, which has over ten tokens already."""
    return F.regexp_extract(rest, r"(?U)\s([0-9.]++)\s*+\z", 1).try_cast("double")


def status_class(status: Column) -> Column:
    """Severity class of a status code; null where it is no number."""
    code = status.try_cast("double")
    return (F.when(code >= 500, "server_error").when(code >= 400, "client_error")
            .when(code.isNotNull(), "ok"))
