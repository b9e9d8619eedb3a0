import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtide import sinks, sources
from logtide.operators import alerts as A, reports as R

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", 0, T0, 9.375, 1500.5, 0.1, False),
            ("a", 1, T0 + timedelta(hours=1), 5.0, 1000.0, 0.76, False),
            ("b", 0, T0, 0.0, 0.0, -0.20005, True),
            ("b", 1, T0 + timedelta(hours=1), 1.0, 2.0, None, None)]
    return spark.createDataFrame(
        rows, "source string, window_id bigint, timestamp timestamp, error_rate_5xx double, "
              "avg_response_time double, anomaly_score double, is_anomaly boolean")


def test_rules(scored):
    got = {(r.source, r.window_id, r.alert_type): (r.message, r.severity)
           for r in A.alerts_every_window(scored).collect()}
    assert got == {
        ("a", 0, "error_rate"): ("5xx 에러 비율이 9.38%로 임계값을 초과했습니다.", "high"),
        ("a", 0, "response_time"): ("평균 응답 시간이 1500.50ms로 임계값을 초과했습니다.", "medium"),
        ("a", 1, "anomaly"): ("이상 패턴이 감지되었습니다. (점수: 0.7600)", "high"),
        ("b", 0, "anomaly"): ("이상 패턴이 감지되었습니다. (점수: -0.2001)", "high"),
    }


def test_alerts_do_not_depend_on_the_order_of_rows(logs):
    from logtide.operators.windows import window_features
    made = [A.alerts_every_window(window_features(logs.repartition(n), 3600),
                                  response_time=60.0) for n in (1, 7, 16)]
    assert made[0].count() > 0
    assert all(made[0].exceptAll(x).count() == 0 == x.exceptAll(made[0]).count()
               for x in made[1:])


def test_latest_only(scored):
    assert [(r.source, r.alert_type) for r in A.alerts_all(scored).collect()] == [("a", "anomaly")]
    assert A.alerts_all(scored.drop("anomaly_score", "is_anomaly")).count() == 0
    assert A.alerts_all(scored.limit(0)).count() == 0


def test_counts_and_retention(scored):
    alerts = A.alerts_every_window(scored)
    assert {r.alert_type: r.alert_count for r in A.alert_count_by_type(alerts).collect()} == {
        "error_rate": 1, "response_time": 1, "anomaly": 2}
    recent = A.alerts_recent(alerts, 2).collect()
    assert len(recent) == 2 and {r.total_count for r in recent} == {4}
    assert A.alert_retention(alerts, 1, "source").count() == 2
    assert A.recent_anomaly_alerts(alerts).first()[0] == 2


def test_tables_round_trip(spark, logs, features, scored, tmp_path):
    for name, frame in (("logs", logs), ("features", features)):
        path = str(tmp_path / name)
        getattr(sinks, f"write_{name}")(frame, path)
        getattr(sinks, f"write_{name}")(frame, path)
        table = spark.read.parquet(path)
        assert table.count() == 2 * frame.count()
        assert table.filter("created_at is null or timestamp is null").count() == 0
    stored = spark.read.parquet(str(tmp_path / "logs"))
    assert stored.filter("raw_log is null").count() == 0
    found = sources.scan_logs(stored, "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    results = str(tmp_path / "results")
    sinks.write_anomaly_results(scored.withColumn("model_type", F.lit("x")), results)
    assert spark.read.parquet(results).filter("window_start = timestamp").count() == 4


def test_alert_defaults(spark, tmp_path):
    path = str(tmp_path / "alerts")
    given = spark.createDataFrame([(None, "x")], "severity string, message string")
    sinks.write_alerts(given, path, as_of=T0)
    row = spark.read.parquet(path).first()
    assert (row.alert_type, row.message, row.severity, row.metadata, row.timestamp) == (
        "unknown", "x", "medium", "{}", T0)


def test_exports(spark, scored, tmp_path):
    odd = scored.withColumn("note", F.lit('say "hi", then\nleave'))
    path = str(tmp_path / "csv")
    sinks.export_features_csv(odd, path)
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .csv(path))
    assert back.filter(F.col("note") == F.lit('say "hi", then\nleave')).count() == 4
    assert back.filter("timestamp = '2024-01-01 01:00:00'").count() == 2
    alerts = A.alerts_every_window(scored)
    path = str(tmp_path / "json")
    sinks.export_alerts_json(alerts, path)
    rows = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {r["timestamp"] for r in rows} == {"2024-01-01T00:00:00", "2024-01-01T01:00:00"}


def test_outbox(scored):
    alerts = A.alerts_every_window(scored)
    rows = sinks.alert_outbox(alerts, {"email": True, "webhook": False}).collect()
    assert len(rows) == 4 and {r.channel for r in rows} == {"email"}
    one = next(r for r in rows if r.alert_type == "response_time")
    assert one.subject == "[로그 이상 탐지] 보통 - 2024-01-01 00:00:00"
    payload = json.loads(one.payload)
    assert payload["severity"] == "medium" and payload["details"]["type"] == "response_time"
    assert sinks.alert_outbox(alerts, {}).count() == 0


def test_reports_on_empty_tables(spark, logs, features, scored):
    none = logs.limit(0)
    alerts = A.alerts_every_window(scored)
    assert R.recent_error_rate(none).first()[0] == 0
    stats = R.db_statistics(none, features.limit(0), scored.limit(0), alerts.limit(0)).first()
    assert (stats.total_logs, stats.latest_log_time, stats.total_alerts) == (0, None, 0)
    parsed = none.withColumn("parse_ok", F.lit(True))
    metrics = R.dashboard_metrics(parsed, features.limit(0), alerts.limit(0)).first()
    assert (metrics.total_logs, metrics.success_rate, metrics.error_rate) == (0, 0, 0)
    assert R.display_projection(logs.drop("ip")).columns == [
        "timestamp", "method", "url_path", "status_code"]
    made = json.loads(R.report(none, features, alerts, "forest", T0).first().report)
    assert made["statistics"]["anomaly_count"] == 2 and made["model"] == "forest"
    assert made["logs_count"] == 0 and made["timestamp"] == "2024-01-01T00:00:00.000000"


def test_scan_recent_days(logs):
    rows = sources.scan_recent_days(logs, "2024-01-20 12:00:00", limit=None)
    assert rows.filter("timestamp < '2024-01-13 12:00:00' or timestamp > '2024-01-20 12:00:00'"
                       ).count() == 0
    assert rows.count() == logs.filter(
        "timestamp between '2024-01-13 12:00:00' and '2024-01-20 12:00:00'").count()
    assert sources.scan_recent_days(logs, "2024-01-20 12:00:00", limit=7).count() == 7


def test_days_do_not_depend_on_the_time_zone(spark, logs, tmp_path):
    path, zone = str(tmp_path / "logs"), spark.conf.get("spark.sql.session.timeZone")
    start = datetime(2024, 1, 5, tzinfo=timezone.utc)
    expected = logs.filter(F.col("timestamp") >= F.lit(start)).count()
    sinks.write_logs(logs, path)
    try:
        for other in ("Asia/Seoul", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", other)
            found = sources.scan_logs(spark.read.parquet(path), start, limit=10 ** 6)
            assert found.count() == expected
            assert "PartitionFilters: [isnotnull(event_date" in \
                found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rules_see_values_unrounded(spark):
    frame = spark.createDataFrame([(5.0000000003,), (5.0,)], "error_rate_5xx double")
    assert [r.value for r in A.alerts_every_window(frame).collect()] == [5.0]
