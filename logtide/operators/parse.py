"""Raw lines to typed log rows, and the counts and rejects that come with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import LINE_FIELDS, LINE_STAGES, PARSE_ERRORS, REJECT_PREFIX
from ..functions.log_line import (
    SPLIT_SIZE, log_time, null_dash, response_time_of_line, response_time_of_rest,
    split_line, url_path,
)
from ..schemas import PARSED_LOG


def parse_access_log(lines: DataFrame, log_type: str | Column = "nginx",
                     log_format: str | Column = "combined", value_col: str = "value",
                     on_bad_time: str = "ingest", ingest_time=None,
                     pattern: str | None = None) -> DataFrame:
    """Parse the lines in ``value_col``; all other columns are passed through.

    ``log_type`` and ``log_format`` are names, or columns when lines of several formats
    are mixed. Lines that do not parse stay in, with ``parse_ok`` false and null fields.
    A time that is no time becomes ``ingest_time`` (default: now), or rejects the line
    with ``on_bad_time='reject'``.
    """
    if on_bad_time not in ("ingest", "reject"):
        raise ValueError(f"on_bad_time must be 'ingest' or 'reject', not {on_bad_time!r}")
    line = F.col(value_col)
    is_common = _is_common(log_type, log_format)
    others = [c for c in lines.columns if c != value_col]

    # What must be worked out once per line sits in one-element explodes: the optimizer
    # would otherwise copy the line pattern and the time parsing into every filter and
    # column above. The explodes stay inside the same generated stage, and the columns
    # become plain look-ups, which keeps that stage small enough to be compiled.
    def once(df, value, name):
        return df.withColumn(name, F.explode(F.array(value)))

    raw = F.col("raw_line")
    split = once(lines.select(*others, line.alias("raw_line")),
                 split_line(raw, is_common, pattern), "_f")

    def field(array, name):
        return F.get(array, F.lit(LINE_FIELDS.index(name)))

    typed = once(split, F.struct(
        log_time(field("_f", "time_local")).alias("time"),
        field("_f", "status").try_cast("int").alias("status"),
        field("_f", "body_bytes_sent").try_cast("bigint").alias("size")), "_v")
    ok = ((F.size("_f") == SPLIT_SIZE) & F.col("_v.status").isNotNull()
          & F.col("_v.size").isNotNull())
    if on_bad_time == "reject":
        ok = ok & F.col("_v.time").isNotNull()
    # Without fields and checked values every column of a rejected line is null.
    checked = once(typed, F.struct(
        ok.alias("ok"), F.when(ok, F.col("_f")).alias("fields"),
        F.when(ok, F.col("_v")).alias("value")), "_c")

    def text(name):
        return field("_c.fields", name)

    rest = F.get("_c.fields", F.lit(len(LINE_FIELDS)))
    if pattern is not None or is_common is True:
        response_time = F.when(F.col("_c.ok"), response_time_of_line(raw))
    elif is_common is False:
        response_time = response_time_of_rest(rest)
    else:
        response_time = F.when(F.col("_c.ok") & is_common, response_time_of_line(raw)).when(
            ~is_common, response_time_of_rest(rest))
    referer = text("http_referer")
    if is_common is False:
        referer = null_dash(referer)
    elif is_common is not True:
        referer = F.when(is_common, referer).otherwise(null_dash(referer))
    timestamp = F.col("_c.value.time")
    if on_bad_time == "ingest":
        now = ingest_time if isinstance(ingest_time, Column) else (
            F.current_timestamp() if ingest_time is None
            else F.lit(ingest_time).cast("timestamp"))
        timestamp = F.coalesce(timestamp, F.when(F.col("_c.ok"), now))
    values = {
        "ip": text("ip"), "remote_user": null_dash(text("remote_user")),
        "timestamp": timestamp, "method": text("method"), "url": text("url"),
        "url_path": url_path(text("url")), "protocol": text("protocol"),
        "status_code": F.col("_c.value.status"), "body_bytes_sent": F.col("_c.value.size"),
        "http_referer": referer, "user_agent": text("user_agent"),
        "response_time": response_time, "raw_line": raw,
    }
    return checked.select(*others, *[values[n].alias(n) for n in PARSED_LOG.names],
                          F.col("_c.ok").alias("parse_ok"))


def _is_common(log_type, log_format):
    """True, False, or a Column that decides per row. Only Apache has a common format."""
    if isinstance(log_type, str) and log_type.lower() != "apache":
        return False
    if isinstance(log_type, str) and isinstance(log_format, str):
        return log_format.lower() != "combined"
    apache = F.lower(log_type) == "apache" if isinstance(log_type, Column) else F.lit(True)
    common = (F.lower(log_format) != "combined" if isinstance(log_format, Column)
              else F.lit(log_format.lower() != "combined"))
    return F.coalesce(apache & common, F.lit(False))


def parsed_only(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parse_ok").drop("parse_ok")


def parse_stats(parsed: DataFrame, by: str | None = "source") -> DataFrame:
    """Parsed, failed and total lines and the success rate in percent."""
    grouped = parsed.groupBy(by) if by else parsed.groupBy()
    counted = grouped.agg(F.count_if("parse_ok").alias("parsed_count"),
                          F.count_if(~F.col("parse_ok")).alias("error_count"),
                          F.count(F.lit(1)).alias("total_count"))
    rate = F.coalesce(F.try_divide(F.col("parsed_count"), F.col("total_count")) * 100,
                      F.lit(0.0))
    return counted.withColumn("success_rate", rate)


def ingest_summary(parsed: DataFrame) -> DataFrame:
    """One row for a submitted batch of lines: processed, parsed, failed."""
    return parsed.agg(F.count(F.lit(1)).alias("processed"),
                      F.count_if("parse_ok").alias("parsed"),
                      F.count_if(~F.col("parse_ok")).alias("failed"))


def dead_letter(parsed: DataFrame) -> DataFrame:
    """Lines that did not parse, whole, with the short form used in messages."""
    others = [c for c in parsed.columns
              if c not in PARSED_LOG.names and c != "parse_ok"]
    return parsed.filter(~F.col("parse_ok")).select(
        *others, "raw_line", F.substring("raw_line", 1, REJECT_PREFIX).alias("line_start"))


def error_field(line: Column, is_common: bool = False) -> Column:
    """The first part of a rejected line that does not look as it must; ``time``, ``status`` or
    ``size`` also where it looks right but is no time or too large a number."""
    prefix, out = r"(?U)^\s*+", None
    for name, pattern in LINE_STAGES[:5 if is_common else 6]:
        prefix += pattern
        fails = ~line.rlike(prefix)
        out = F.when(fails, name) if out is None else out.when(fails, name)
    number = lambda n: F.regexp_extract(line, r'" (\d++) (\d++)', n)
    bad_status = number(1).try_cast("int").isNull()
    return (out.when(bad_status, "status").when(number(2).try_cast("bigint").isNull(), "size")
            .otherwise("time"))


def parse_error_breakdown(parsed: DataFrame, by: str | None = "source", is_common: bool = False
                          ) -> DataFrame:
    """Rejected lines by the part at which they fail and the cause that this is counted as.

    Only lines that were rejected are looked at, part by part; good ones cost nothing.
    """
    field = error_field(F.col("raw_line"), is_common)
    named = parsed.filter(~F.col("parse_ok")).withColumn("field", field)
    kinds = F.create_map(*[F.lit(x) for pair in PARSE_ERRORS.items() for x in pair])
    keys = ([by] if by else []) + ["field"]
    return (named.groupBy(*keys).agg(F.count(F.lit(1)).alias("error_count"))
            .select(*keys, F.element_at(kinds, F.col("field")).alias("category"), "error_count"))
