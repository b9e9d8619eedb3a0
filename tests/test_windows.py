import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.constants import CHANGE_COLUMNS, FEATURE_COLUMNS
from logtide.operators import windows as W
from logtide.operators.history import cap_recent, merge_features
from logtide.operators.quantiles import exact_quantile
from logtide.operators.scaling import normalize_features

T0 = datetime(2024, 1, 1, 0, 0, 7)
SCHEMA = ("source string, timestamp timestamp, ip string, method string, url_path string, "
          "status_code int, body_bytes_sent bigint, response_time double")


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows, at = [], T0
    for i in range(n):
        at += timedelta(seconds=int(rng.integers(0, 50)) + (4000 if i % 97 == 96 else 0))
        rows.append((
            "hot" if rng.random() < 0.8 else f"s{rng.integers(3)}", at,
            None if rng.random() < 0.05 else f"10.0.0.{rng.integers(5)}",
            str(rng.choice(["GET", "POST", "PUT"])),
            None if rng.random() < 0.05 else f"/p{rng.integers(4)}",
            int(rng.choice([200, 404, 400, 500, 503])), int(rng.integers(1000)),
            None if rng.random() < 0.4 else float(rng.integers(1, 500)) / 10))
    return rows


def brute_force(rows, width, rps_seconds=60):
    """Window by window over plain lists."""
    out = {}
    for source in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == source]
        first = min(r[1] for r in mine)
        by_window = {}
        for r in mine:
            by_window.setdefault((r[1] - first) // timedelta(seconds=width), []).append(r)
        before = None
        for wid in sorted(by_window):
            part = by_window[wid]
            n = len(part)
            times = [r[7] for r in part if r[7] is not None]
            ips, paths = (pd.Series([r[k] for r in part], dtype=object).value_counts()
                          for k in (2, 4))
            f = {
                "total_requests": n, "rps": n / rps_seconds,
                "error_rate_5xx": sum(r[5] >= 500 for r in part) / n * 100,
                "error_rate_4xx": sum(400 <= r[5] < 500 for r in part) / n * 100,
                "error_rate_404": sum(r[5] == 404 for r in part) / n * 100,
                "avg_response_time": float(np.mean(times)) if times else 0.0,
                "max_response_time": max(times, default=0.0),
                "min_response_time": min(times, default=0.0),
                "std_response_time": (float(np.std(times, ddof=1)) if len(times) > 1
                                      else None if times else 0.0),
                "unique_ips": len(ips), "top_ip_count": int(ips.max()) if len(ips) else 0,
                "unique_paths": len(paths), "top_path_count": int(paths.max()) if len(paths) else 0,
                "top_path_ratio": (int(paths.max()) if len(paths) else 0) / n,
                "get_ratio": sum(r[3] == "GET" for r in part) / n,
                "post_ratio": sum(r[3] == "POST" for r in part) / n,
            }
            for c in CHANGE_COLUMNS:
                f[f"{c}_change"] = ((f[c] - before[c]) / before[c] * 100
                                    if before and before[c] > 0 else 0.0)
            before = f
            out[source, wid] = (first + wid * timedelta(seconds=width), f)
    return out


def check(result, expected):
    rows = {(r.source, r.window_id): r for r in result.collect()}
    assert set(rows) == set(expected)
    for key, (start, f) in expected.items():
        assert rows[key].timestamp == start
        for name, value in f.items():
            got = rows[key][name]
            assert (got is None) == (value is None), (key, name)
            assert value is None or got == pytest.approx(value, abs=1e-9), (key, name)


@pytest.mark.parametrize("width", [60, 600])
def test_against_brute_force(spark, width):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = brute_force(rows, width)
    check(W.window_features(frame.repartition(1), width), expected)
    check(W.window_features(frame.repartition(16), width), expected)


def test_change_rates_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(W, "WINDOW_CHUNK", 4)
    rows = sample()
    check(W.window_features(spark.createDataFrame(rows, SCHEMA), 60), brute_force(rows, 60))


def test_many_sources_use_a_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(W, "collect_bounded", lambda df: None)
    rows = sample()
    check(W.window_features(spark.createDataFrame(rows, SCHEMA), 300), brute_force(rows, 300))


def test_epoch_alignment_and_stored_anchor(spark):
    frame = spark.createDataFrame(sample(), SCHEMA)
    starts = [r.timestamp for r in W.window_features(frame, 300, align="epoch").collect()]
    assert all(int((t - datetime(1970, 1, 1)).total_seconds()) % 300 == 0 for t in starts)
    anchor = W.anchors(frame).withColumn("anchor", F.expr("anchor + interval 10 minutes"))
    shifted = W.window_features(frame, 600, anchor=anchor)
    plain = W.window_features(frame, 600)
    assert (shifted.agg(F.min("window_id")).first()[0] == -1
            and shifted.count() == plain.count())


def test_before_epoch_is_floored(spark):
    frame = spark.createDataFrame([("a", datetime(1969, 12, 31, 23, 59, 30), "i", "GET", "/", 200,
                                    1, 1.0)], SCHEMA)
    row = W.window_features(frame, 60, align="epoch").first()
    assert row.window_id == -1 and row.timestamp == datetime(1969, 12, 31, 23, 59)


def test_missing_columns(spark):
    frame = spark.createDataFrame(sample(), SCHEMA)
    out = W.window_features(frame.drop("response_time", "url_path", "method"), 600)
    assert "get_ratio" not in out.columns and "post_ratio" not in out.columns
    row = out.agg(F.max("unique_paths"), F.max("top_path_count"), F.max("top_path_ratio"),
                  F.max("max_response_time")).first()
    assert row[:3] == (0, 0, 0)
    assert row[3] == frame.agg(F.max("body_bytes_sent")).first()[0] / 1000
    assert "source" in W.window_features(frame.drop("source"), 600).columns


def test_single_request_has_no_spread(spark):
    row = W.window_features(spark.createDataFrame(sample(1), SCHEMA)).first()
    assert row.total_requests == 1 and not row.std_response_time


def test_fill_gaps(spark, monkeypatch):
    frame = spark.createDataFrame(sample(), SCHEMA)
    plain = W.window_features(frame, 60)
    filled = W.window_features(frame, 60, fill_gaps=True)
    span = {r.source: r.n for r in plain.groupBy("source").agg(
        (F.max("window_id") - F.min("window_id") + 1).alias("n")).collect()}
    got = {r.source: (r.n, r.total) for r in filled.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_requests").alias("total")).collect()}
    assert {s: n for s, (n, _) in got.items()} == span
    assert sum(t for _, t in got.values()) == 400
    assert filled.filter("total_requests > 0").exceptAll(plain).count() == 0
    monkeypatch.setattr(W, "WINDOW_CHUNK", 4)
    again = W.window_features(frame, 60, fill_gaps=True)
    assert again.exceptAll(filled).count() == 0 == filled.exceptAll(again).count()
    # Every start is a whole number of windows after the anchor of its source.
    phases = filled.selectExpr("source", "unix_seconds(timestamp) - 60 * window_id as phase")
    assert phases.distinct().count() == len(span)
    zero = filled.filter("total_requests = 0").first()
    assert all(zero[c] == 0 for c in FEATURE_COLUMNS)


def test_empty_input(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert W.window_features(frame).count() == 0
    assert W.features_job(W.window_features(frame)).first()[0] == 0
    assert normalize_features(W.window_features(frame)).count() == 0


def test_properties(features, logs):
    total = features.agg(F.sum("total_requests")).first()[0]
    assert total == logs.count()
    bad = features.filter(
        "error_rate_5xx not between 0 and 100 or error_rate_4xx not between 0 and 100 "
        "or top_ip_count > total_requests or top_path_count > total_requests "
        "or unique_ips > total_requests or get_ratio + post_ratio > 1.000001")
    assert bad.count() == 0


def test_normalize(spark, features):
    scaled = normalize_features(features.withColumn("constant", F.lit(7)))
    low, high = (scaled.agg(*[f(c) for c in FEATURE_COLUMNS if c != "std_response_time"]).first()
                 for f in (F.min, F.max))
    assert set(low) == {0.0} and set(high) <= {0.0, 1.0}
    assert scaled.filter("constant <> 0").count() == 0


def test_plan_reads_logs_once_and_combines_early(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame(sample(), SCHEMA).write.parquet(path)
    plan = W.window_features(spark.read.parquet(path), 60, align="epoch")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "partial_count" in text and "SortAggregate" not in text


def test_merge_and_caps(spark):
    rows = [("a", T0 + timedelta(minutes=i), i) for i in range(5)]
    old = spark.createDataFrame(rows[:3], "source string, timestamp timestamp, v int")
    new = spark.createDataFrame([(s, t, v + 100) for s, t, v in rows[1:]], old.schema)
    merged = {r.timestamp: r.v for r in merge_features(old, new).collect()}
    assert [merged[r[1]] for r in rows] == [0, 1, 2, 103, 104]
    assert merge_features(old, new, keep=2).count() == 2
    assert merge_features(old, new, keep=None).count() == 5
    both = old.union(new.withColumn("source", F.lit("b")))
    assert cap_recent(both, 2, "source").groupBy("source").count().filter("count = 2").count() == 2
    assert {r.v for r in cap_recent(both, 1).collect()} == {104}


@pytest.mark.parametrize("count", [1, 30, 150, 399, 400, 1000])
def test_large_top_k_is_narrowed_by_time(spark, monkeypatch, count):
    from logtide.operators import history
    frame = spark.createDataFrame(sample() + [("x", None, "i", "GET", "/", 200, 1, 1.0)], SCHEMA)
    plain = history.top_recent(frame, count).collect()
    monkeypatch.setattr(history, "LARGE_COUNT", 0)
    assert history.top_recent(frame, count).collect() == plain
    busy = frame.withColumn("timestamp", F.date_trunc("day", "timestamp"))
    assert history.top_recent(busy, count).count() == min(count, 401)
    monkeypatch.setattr(history, "MAX_STEPS", 1)
    assert history.top_recent(frame, count).collect() == plain


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(
        size=1000) ** 8])
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    expected = float(np.quantile(values, q))
    assert exact_quantile(frame, "v", q) == pytest.approx(expected, abs=1e-12)
    assert exact_quantile(frame, "v", q, direct_rows=10) == pytest.approx(expected, abs=1e-12)


def test_exact_quantile_narrows(spark, monkeypatch):
    from logtide.operators import quantiles
    monkeypatch.setattr(quantiles, "LAST_BUCKET", 2)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    values = [math.exp(i / 50) for i in range(1000)] + [5.0] * 300
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_quantile(frame, "v", 0.3, direct_rows=10) == pytest.approx(
        float(np.quantile(values, 0.3)))
    assert exact_quantile(frame.limit(0), "v", 0.3) is None


@pytest.mark.parametrize("direct", [0, 1_000])
def test_quantile_with_nan_and_infinities(spark, direct):
    inf = float("inf")
    values = [float("nan"), None, -inf, 1.0, 2.0, 3.0, 1e308, -1e308, inf]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = [-inf, -1e308, 1.0, 2.0, 3.0, 1e308, inf]
    for rank, expected in enumerate(ordered):
        assert exact_quantile(frame, "v", rank / 6, direct_rows=direct) == expected
    assert exact_quantile(frame, "v", 2.5 / 6, direct_rows=direct) == pytest.approx(1.5)
    assert exact_quantile(frame.filter("isnan(v)"), "v", 0.5, direct_rows=direct) is None


def test_logs_are_read_once(spark, logs):
    """Anchors and windows start from columns that were written in one pass."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = logs.mapInArrow(passed, logs.schema)
    features = W.window_features(counted, 3600).toPandas()
    assert read.value == logs.count()
    assert int(features["total_requests"].sum()) == read.value
    W.window_features(counted, 3600, align="epoch").toPandas()
    assert read.value == 2 * logs.count()
