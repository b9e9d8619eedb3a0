import os

import pytest
from pyspark.sql import functions as F

from logtide.constants import FEATURE_COLUMNS
from logtide.operators import isolation_forest as IF
from logtide.operators.parse import parsed_only
from logtide.operators.similarity import with_vector
from logtide.operators.windows import window_features
from logtide.plans import access_log
from logtide.sources import read_log_stream
from logtide.streaming import (
    closed_windows, current_rows, newest, observe_parse_stats, read_batches, start_pipeline,
)

from samples import SF


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The log in four files in time order, one micro-batch each."""
    path = tmp_path_factory.mktemp("incoming")
    rows = access_log.lines(spark, SF).orderBy("log_id").collect()
    size = -(-len(rows) // 4)
    for i in range(4):
        name = path / f"{i}.log"
        name.write_text("\n".join(r.value for r in rows[i * size:(i + 1) * size]) + "\n")
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def stream(spark, folder, **options):
    return parsed_only(read_log_stream(spark, folder, source=F.lit("all"), on_bad_time="reject",
                                       max_files_per_trigger=1, **options))


@pytest.fixture(scope="module")
def batch(logs):
    return window_features(logs.withColumn("source", F.lit("all")), 3600, align="epoch").cache()


def closed(batch, logs):
    last = logs.agg(F.max("timestamp")).first()[0]
    return batch.filter(F.col("timestamp") + F.expr("interval 1 hour")
                        <= F.lit(last) - F.expr("interval 1 hour"))


def rounded(df):
    return df.select("source", "window_id", "timestamp",
                     *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURE_COLUMNS])


def test_pipeline_equals_batch(spark, folder, batch, logs, tmp_path):
    model = IF.iforest_fit(with_vector(batch), ["source", "window_id"], n_estimators=10)
    seen = []
    query = start_pipeline(
        stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "check"), 3600, "1 hour",
        model=model, channels=("webhook",), thresholds={"response_time": 60.0},
        callbacks=(lambda features, i: seen.append((i, features.count())),))
    query.awaitTermination()
    out = str(tmp_path / "out")
    got = read_batches(spark, out, "features")
    expected = closed(batch, logs)
    assert rounded(got).exceptAll(rounded(expected)).count() == 0
    assert got.count() == expected.count() == sum(n for _, n in seen)
    assert len(seen) >= 4 and got.select("batch_id").distinct().count() > 1
    scores = IF.iforest_score(with_vector(expected), model)
    stored = read_batches(spark, out, "anomaly_results").select(
        "window_id", F.col("anomaly_score").alias("s"))
    assert scores.join(stored, "window_id").filter("abs(s - anomaly_score) < 1e-9").count() == \
        expected.count()
    alerts = read_batches(spark, out, "alerts")
    assert alerts.groupBy("window_id", "alert_type").count().filter("count > 1").count() == 0
    assert alerts.filter("alert_type = 'error_rate'").count() == expected.filter(
        "error_rate_5xx > 5").count()
    assert read_batches(spark, out, "outbox").count() == alerts.count()


def test_late_rows_are_dropped_and_counted(spark, folder, batch, logs, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for i in range(4):
        text = open(f"{folder}/{i}.log").read()
        (incoming / f"{i}.log").write_text(text)
        os.utime(incoming / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    start_pipeline(stream(spark, str(incoming)), out, check, 3600, "1 hour").awaitTermination()
    (incoming / "late.log").write_text(open(f"{folder}/0.log").read())
    query = start_pipeline(stream(spark, str(incoming)), out, check, 3600, "1 hour")
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress
                  for op in p.stateOperators)
    assert dropped > 0
    assert rounded(read_batches(spark, out, "features")).exceptAll(
        rounded(closed(batch, logs))).count() == 0
    assert read_batches(spark, out, "features").count() == closed(batch, logs).count()


def test_start_from_latest(spark, folder, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "old.log").write_text(open(f"{folder}/0.log").read())
    os.utime(incoming / "old.log", (1_700_000_000, 1_700_000_000))
    fresh = open(f"{folder}/1.log").read()
    (incoming / "new.log").write_text(fresh)
    rows = read_log_stream(spark, str(incoming), source=F.lit("all"),
                           start_from_latest="2024-01-01 00:00:00")
    query = (rows.writeStream.format("memory").queryName("latest").option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("latest").count() == len(fresh.splitlines())


def test_parse_stats_of_stream(spark, folder, tmp_path):
    rows = observe_parse_stats(read_log_stream(spark, folder, source=F.lit("all"),
                                               max_files_per_trigger=1))
    query = (rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    seen = [p.observedMetrics["parse_stats"] for p in query.recentProgress if p.numInputRows]
    lines = sum(len(open(f"{folder}/{i}.log").read().splitlines()) for i in range(4))
    assert len(seen) == 4 and sum(s.total_count for s in seen) == lines
    assert sum(s.error_count for s in seen) > 0


def test_stored_parse_stats_count_every_batch(spark, folder, tmp_path):
    from logtide.streaming import store_parse_stats, stored_parse_stats
    rows = read_log_stream(spark, folder, source=F.lit("all"), max_files_per_trigger=1)
    store_parse_stats(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    total = stored_parse_stats(spark, str(tmp_path / "out")).first()
    lines = sum(len(open(f"{folder}/{i}.log").read().splitlines()) for i in range(4))
    assert total.total_count == lines == total.parsed_count + total.error_count
    assert total.success_rate == pytest.approx(100 * total.parsed_count / lines)
    assert read_batches(spark, str(tmp_path / "out"), "parse_stats").select("batch_id").distinct().count() == 4


def test_rerun_of_a_batch_replaces_it(spark, batch, tmp_path):
    from logtide.streaming.tables import write_batch
    for _ in range(2):
        write_batch(batch.limit(5), str(tmp_path), "features", 0)
    assert read_batches(spark, str(tmp_path), "features").count() == 5


def test_closed_windows_has_no_python(spark, folder):
    plan = closed_windows(stream(spark, folder), 3600, "1 hour")
    assert plan.isStreaming and "Python" not in plan._jdf.queryExecution().analyzed().toString()


def test_lost_state_is_an_error(spark, tmp_path):
    from logtide.streaming.pipeline import _state_before
    assert _state_before(spark, str(tmp_path), 0) is None
    with pytest.raises(RuntimeError, match="batch 4"):
        _state_before(spark, str(tmp_path), 5)


@pytest.mark.parametrize("order", [(3, 0, 2, 1), (1, 0, 3, 2)])
def test_late_rows_correct_their_windows(spark, folder, batch, logs, tmp_path, order):
    """The log in an order in which most rows are late: the newest versions equal the batch."""
    incoming, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    incoming.mkdir()
    lines = {i: open(f"{folder}/{i}.log").read().splitlines(True) for i in range(4)}
    for n, i in enumerate(order):
        # every file also has some lines of the next, so that windows are cut in two
        mine = [x for j, x in enumerate(lines[i]) if j % 5] + [
            x for j, x in enumerate(lines[order[n - 1]]) if j % 5 == 0]
        (incoming / f"{n}.log").write_text("".join(mine))
        os.utime(incoming / f"{n}.log", (1_700_000_000 + n, 1_700_000_000 + n))
        start_pipeline(stream(spark, str(incoming)), out, check, 3600, "1 hour", late="correct",
                       thresholds={"response_time": 60.0}, channels=("webhook",)).awaitTermination()
    versions = read_batches(spark, out, "features")
    got, expected = newest(versions), closed(batch, logs).cache()
    assert versions.count() > got.count() == expected.count()
    assert rounded(got).exceptAll(rounded(expected)).count() == 0
    alerts = current_rows(read_batches(spark, out, "alerts"), versions)
    assert alerts.filter("alert_type = 'error_rate'").count() == expected.filter("error_rate_5xx > 5").count()
    assert alerts.groupBy("source", "window_id", "alert_type").count().filter("count > 1").count() == 0


def test_repeated_batch_of_late_rows_counts_once(spark, logs, tmp_path):
    from logtide.streaming.late import LateWindows
    windows = LateWindows(str(tmp_path), 3600, "0 seconds")
    one = logs.withColumn("source", F.lit("all"))
    first = windows.take(one, 0).agg(F.sum("total_requests")).first()[0]
    assert windows.take(one, 0).agg(F.sum("total_requests")).first()[0] == first > 0
    assert windows.take(one.limit(0), 1).count() == 0
    twice = windows.take(one, 2).agg(F.sum("total_requests")).first()[0]
    assert twice == 2 * first
    with pytest.raises(RuntimeError, match="batch 4"):
        windows.take(one, 5)
