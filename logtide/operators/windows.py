"""Log rows to one row of numeric features per source and time window.

The logs are read and parsed once. Every row is expanded into the row itself, its
client and its path; a first aggregation counts per (source, window, client or path) with
map-side combine, so neither a source nor a window that holds much of the data ends up in
one task, and a second one reduces those counts to one row per window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CHANGE_COLUMNS, FEATURE_COLUMNS, FEATURE_INPUT_LOGS, WINDOW_SECONDS
from ..session import collect_bounded, materialize
from .history import top_recent

MICROS = 1_000_000
# Windows per partition of the analytic steps, so that one busy source is spread out.
WINDOW_CHUNK = 4096
_ROW, _IP, _PATH = 0, 1, 2
_NUMBERS = ("int", "bigint", "double")


def anchors(logs: DataFrame) -> DataFrame:
    """First timestamp of each source: where its windows start."""
    return logs.groupBy("source").agg(F.min("timestamp").alias("anchor"))


def with_anchor(logs: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Attach the anchor of its source to every row.

    The anchors are broadcast only after counting that there are few; beyond that the
    join is a shuffle join on source and a salt, as one source can hold much of the data.
    """
    spark = logs.sparkSession
    found = anchors(logs) if anchor is None else anchor.select("source", "anchor")
    # Literals as microseconds, so that no session time zone is involved.
    micros = found.select("source", F.unix_micros("anchor").alias("_t0"))
    rows = collect_bounded(micros)
    if rows is not None:
        small = spark.createDataFrame([tuple(r) for r in rows], micros.schema)
        return logs.join(F.broadcast(small), logs["source"].eqNullSafe(small["source"])
                         ).drop(small["source"])
    salts = 64
    spread = micros.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = logs.withColumn(
        "_salt", F.pmod(F.xxhash64("timestamp", "ip"), F.lit(salts)).cast("int"))
    same = (salted["source"].eqNullSafe(spread["source"])
            & (salted["_salt"] == spread["_salt"]))
    return salted.join(spread, same).drop(spread["source"]).drop("_salt")


def assign_windows(logs: DataFrame, window_seconds: int = WINDOW_SECONDS,
                   align: str = "first_event", anchor: DataFrame | None = None) -> DataFrame:
    """Add ``window_id`` and ``window_start`` of the half-open window of each row.

    ``align='first_event'`` starts at the first row of each source (or at ``anchor``, a
    table of source and anchor, for incremental runs); ``'epoch'`` at 1970-01-01.
    """
    if align not in ("first_event", "epoch"):
        raise ValueError(f"align must be 'first_event' or 'epoch', not {align!r}")
    width = window_seconds * MICROS
    if align == "epoch":
        rows = logs.withColumn("_t0", F.lit(0).cast("bigint"))
    else:
        rows = with_anchor(logs, anchor)
    offset = "(unix_micros(timestamp) - _t0)"
    # Integer arithmetic throughout; pmod makes it a floor before the anchor too.
    window_id = F.expr(f"({offset} - pmod({offset}, {width}L)) div {width}L")
    return (rows.withColumn("window_id", window_id)
            .withColumn("window_start",
                        F.timestamp_micros(F.col("_t0") + F.col("window_id") * F.lit(width)))
            .drop("_t0"))


def _expanded(rows: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """Every row as itself, its client and its path; and what its row-level measures read."""
    present = set(rows.columns)
    kinds = [_ROW, _IP] + ([_PATH] if "url_path" in present else [])
    kind = F.col("_kind")
    is_row = kind == _ROW
    key = F.when(kind == _IP, F.col("ip"))
    if "url_path" in present:
        key = key.when(kind == _PATH, F.col("url_path"))

    expanded = rows.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    # Inputs of the row-level measures are null on the client and path copies, so those
    # carry nothing but their count through the shuffle.
    status = F.when(is_row, F.col("status_code"))
    time = F.col("response_time") if "response_time" in present else F.col("body_bytes_sent")
    time = F.when(is_row, time.cast("double"))
    method = F.when(is_row, F.col("method")) if "method" in present else F.lit(None)
    return expanded.withColumn("_key", key), status, time, method


def window_counts(rows: DataFrame, keys: list[str],
                  extra_aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """The two aggregations: rows with window ``keys`` to one row of counts per window.

    Used on batch and streaming rows alike. ``extra_aggs`` maps names to aggregates over
    the log columns, computed in the same pass.
    """
    expanded, status, time, method = _expanded(rows)
    level1 = [
        F.count(F.lit(1)).alias("_n"),
        F.count_if(status >= 500).alias("_n5xx"),
        F.count_if((status >= 400) & (status < 500)).alias("_n4xx"),
        F.count_if(status == 404).alias("_n404"),
        F.count_if(method == "GET").alias("_nget"),
        F.count_if(method == "POST").alias("_npost"),
        F.count(time).alias("_nrt"), F.avg(time).alias("_avg"), F.max(time).alias("_max"),
        F.min(time).alias("_min"), F.stddev_samp(time).alias("_std"),
    ]
    extra_aggs = dict(extra_aggs or {})
    level1 += [column.alias(name) for name, column in extra_aggs.items()]
    counted = expanded.groupBy(*keys, "_kind", "_key").agg(*level1)
    return _reduced(counted, keys, tuple(extra_aggs))


def _reduced(counted: DataFrame, keys: list[str], extras: tuple[str, ...] = ()) -> DataFrame:
    """Counts per window, client and path to one row per window."""
    kind = F.col("_kind")
    is_row = kind == _ROW
    of_row = {name: F.max(F.when(is_row, F.col(name)))
              for name in ("_n", "_n5xx", "_n4xx", "_n404", "_nget", "_npost",
                           "_nrt", "_avg", "_max", "_min", "_std")}
    level2 = [column.alias(name) for name, column in of_row.items()]
    for prefix, k in (("ip", _IP), ("path", _PATH)):
        named = (kind == k) & F.col("_key").isNotNull()
        level2 += [F.count_if(named).alias(f"_unique_{prefix}"),
                   F.coalesce(F.max(F.when(named, F.col("_n"))), F.lit(0).cast("bigint"))
                   .alias(f"_top_{prefix}")]
    level2 += [F.any_value(F.when(is_row, F.col(name)), ignoreNulls=F.lit(True)).alias(name)
               for name in extras]
    return counted.groupBy(*keys).agg(*level2)


_SUMS = ("_n", "_n5xx", "_n4xx", "_n404", "_nget", "_npost", "_nrt", "_sum", "_squares")


def window_partials(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and moments per window ``keys`` and client or path that can be merged later."""
    expanded, status, time, method = _expanded(rows)
    return expanded.groupBy(*keys, "_kind", "_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(status >= 500).alias("_n5xx"),
        F.count_if((status >= 400) & (status < 500)).alias("_n4xx"),
        F.count_if(status == 404).alias("_n404"),
        F.count_if(method == "GET").alias("_nget"),
        F.count_if(method == "POST").alias("_npost"),
        F.count(time).alias("_nrt"), F.sum(time).alias("_sum"), F.sum(time * time).alias("_squares"),
        F.max(time).alias("_max"), F.min(time).alias("_min"))


def merged_counts(partials: DataFrame, keys: list[str]) -> DataFrame:
    """What ``window_counts`` gives for the rows behind all ``partials`` together.

    The spread comes from sums of squares, exact to about nine digits of its ratio to the mean.
    """
    merged = partials.groupBy(*keys, "_kind", "_key").agg(
        *[F.sum(name).alias(name) for name in _SUMS], F.max("_max").alias("_max"),
        F.min("_min").alias("_min"))
    n, total = F.col("_nrt"), F.col("_sum")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("_squares") - total * total / n) / (n - 1)))
    return _reduced(merged.withColumns({"_avg": F.when(n > 0, total / n),
                                        "_std": F.when(n > 1, spread)}), keys)


def features_of_counts(counts: DataFrame, keys: list[Column | str], rps_seconds: int,
                       has_response_time: bool = True, has_method: bool = True,
                       extras: tuple[str, ...] = ()) -> DataFrame:
    """Turn the counts of a window into its features, all but the change rates."""
    n = F.col("_n")

    def percent(name):
        return F.col(name) / n * 100

    def measure(name):
        if has_response_time:
            return F.when(F.col("_nrt") == 0, F.lit(0.0)).otherwise(F.col(name))
        return F.col(name) / 1000

    columns = [
        n.alias("total_requests"), (n / F.lit(rps_seconds)).alias("rps"),
        percent("_n5xx").alias("error_rate_5xx"), percent("_n4xx").alias("error_rate_4xx"),
        percent("_n404").alias("error_rate_404"),
        measure("_avg").alias("avg_response_time"), measure("_max").alias("max_response_time"),
        measure("_min").alias("min_response_time"), measure("_std").alias("std_response_time"),
        F.col("_unique_ip").alias("unique_ips"), F.col("_top_ip").alias("top_ip_count"),
        F.col("_unique_path").alias("unique_paths"), F.col("_top_path").alias("top_path_count"),
        (F.col("_top_path") / n).alias("top_path_ratio"),
    ]
    if has_method:
        columns += [(F.col("_nget") / n).alias("get_ratio"),
                    (F.col("_npost") / n).alias("post_ratio")]
    return counts.select(*keys, *columns, *extras)


def previous_in_source(df: DataFrame, order: str, value: Column, chunk: Column,
                       name: str) -> DataFrame:
    """``lag(value)`` over (source, order) without one partition per source.

    Rows are first chained inside a chunk. Then only the first and last row of each chunk
    meet in one partition per source, which links every chunk to the one before it.
    """
    inside = Window.partitionBy("source", "_chunk").orderBy(order)
    chained = df.withColumns({"_chunk": chunk, "_value": value}).withColumns({
        "_before": F.lag("_value").over(inside),
        "_first": F.row_number().over(inside) == 1,
        "_last": F.lead(F.lit(1)).over(inside).isNull()})
    border = F.when(~(F.col("_first") | F.col("_last")), F.col("_chunk"))
    across = Window.partitionBy("source", border).orderBy(order)
    return (chained.withColumn(name, F.when(F.col("_first"), F.lag("_value").over(across))
                               .otherwise(F.col("_before")))
            .drop("_chunk", "_value", "_before", "_first", "_last"))


def change_rates(features: DataFrame, order: str = "window_id",
                 chunk: Column | None = None) -> DataFrame:
    """Percent change of four features against the previous non-empty window.

    0 for the first window of a source and where the previous value is not positive.
    """
    if chunk is None:
        chunk = _floor_div("window_id", WINDOW_CHUNK)
    value = F.struct(*[F.col(name) for name in CHANGE_COLUMNS])
    linked = previous_in_source(features, order, value, chunk, "_prev")
    rates = []
    for name in CHANGE_COLUMNS:
        before = F.col(f"_prev.{name}")
        rate = F.when(before > 0, (F.col(name) - before) / before * 100).otherwise(F.lit(0.0))
        rates.append(rate.alias(f"{name}_change"))
    return linked.select("*", *rates).drop("_prev")


def window_inputs(logs: DataFrame, *others: str) -> DataFrame:
    """The columns of ``logs`` that windows are made of, and ``others``."""
    time = "response_time" if "response_time" in logs.columns else "body_bytes_sent"
    wanted = ("source", "timestamp", "ip", "status_code", time, "url_path", "method", *others)
    return logs.select(*[c for c in wanted if c in logs.columns])


def window_features(logs: DataFrame, window_seconds: int = WINDOW_SECONDS,
                    rps_seconds: int = WINDOW_SECONDS, align: str = "first_event",
                    anchor: DataFrame | None = None, fill_gaps: bool = False,
                    max_logs: int | None = None,
                    extra_aggs: Mapping[str, Column] | None = None,
                    stored: bool = False) -> DataFrame:
    """Features of every non-empty window of every source, in one pass over ``logs``.

    Where windows start with the first event of a source, that must be known first: the few
    columns that are needed are written once, and anchors and windows both start from them.
    ``stored`` says that ``logs`` is read from a table anyway, and need not be written to one.
    ``rps_seconds`` divides the request count and is independent of the window width.
    ``max_logs`` first cuts the input to the latest rows (off by default);
    ``fill_gaps`` adds zero rows for the empty windows in between.
    Without a ``response_time`` column the byte counts stand in for it, without
    ``url_path`` the path features are 0, without ``method`` its two ratios are left out.
    """
    if "source" not in logs.columns:
        logs = logs.withColumn("source", F.lit("all"))
    if max_logs is not None:
        logs = recent_input(logs, max_logs)
    if align == "first_event" and anchor is None and not stored:
        logs = materialize(logs if extra_aggs else window_inputs(logs), "window-input")[0]
    rows = assign_windows(logs, window_seconds, align, anchor)
    counts = window_counts(rows, ["source", "window_id", "window_start"], extra_aggs)
    extras = tuple(extra_aggs or ())
    features = features_of_counts(
        counts, ["source", "window_id", F.col("window_start").alias("timestamp")],
        rps_seconds, "response_time" in logs.columns, "method" in logs.columns, extras)
    features = change_rates(features)
    order = [c for c in FEATURE_COLUMNS if c in features.columns]
    features = features.select("source", "window_id", "timestamp", *order, *extras)
    return fill_window_gaps(features, window_seconds) if fill_gaps else features


def _floor_div(value: str, width: int) -> Column:
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L")


def fill_window_gaps(features: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add a zero row for every window between the first and last one of its source.

    Each window brings the empty ones before it, so the features are read once and not
    joined. Long gaps are cut into chunks that are spread over the tasks before they are
    written out.
    """
    width = window_seconds * MICROS
    linked = previous_in_source(features, "window_id", F.col("window_id"),
                                _floor_div("window_id", WINDOW_CHUNK), "_prev")
    start = linked.withColumn("_lo", F.coalesce(F.col("_prev") + 1, F.col("window_id")))
    chunks = start.withColumn("_c", F.explode(F.sequence(
        _floor_div("_lo", WINDOW_CHUNK), _floor_div("window_id", WINDOW_CHUNK))))
    first, last = F.col("_c") * WINDOW_CHUNK, F.col("_c") * WINDOW_CHUNK + (WINDOW_CHUNK - 1)
    ids = chunks.repartition("source", "_c").withColumn("_id", F.explode(F.sequence(
        F.greatest(F.col("_lo"), first), F.least(F.col("window_id"), last))))
    real = F.col("_id") == F.col("window_id")
    time = F.timestamp_micros(F.unix_micros("timestamp")
                              - (F.col("window_id") - F.col("_id")) * F.lit(width))
    # A null inside a real window (the spread of a single request) stays null.
    filled = [F.when(real, F.col(c)).otherwise(F.lit(0).cast(kind) if kind in _NUMBERS
                                               else F.lit(None).cast(kind)).alias(c)
              for c, kind in features.dtypes if c not in ("source", "window_id", "timestamp")]
    return ids.select("source", F.col("_id").alias("window_id"), time.alias("timestamp"),
                      *filled)


def recent_input(logs: DataFrame, count: int = FEATURE_INPUT_LOGS) -> DataFrame:
    """The latest ``count`` log rows."""
    return top_recent(logs, count)


def features_job(features: DataFrame) -> DataFrame:
    """Number of windows in a features table."""
    return features.agg(F.count(F.lit(1)).alias("window_count"))
