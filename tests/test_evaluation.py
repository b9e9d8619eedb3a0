"""Curves over thresholds and causes of rejection against plain loops."""

import random

import pytest

from logtide.operators.evaluation import detector_evaluation, threshold_curve
from logtide.operators.parse import parse_access_log, parse_error_breakdown


@pytest.mark.parametrize("worse", [True, False])
def test_curve_equals_counting(spark, worse):
    rng = random.Random(3)
    rows = [(rng.choice([0.1, 0.2, 0.2, 0.5, 0.9, rng.random()]), rng.random() < 0.3) for _ in range(400)]
    flags = [(s, y, s >= 0.5) for s, y in rows]
    odd = [(None, True, None), (float("nan"), True, None), (0.5, None, True)]
    frame = spark.createDataFrame(flags + odd, "anomaly_score double, label boolean, is_anomaly boolean")
    got = {r.threshold: r for r in threshold_curve(frame, higher_is_worse=worse).collect()}
    assert set(got) == {s for s, _ in rows}
    pos = sum(y for _, y in rows)
    for t, r in got.items():
        flagged = [y for s, y in rows if (s >= t if worse else s <= t)]
        assert (r.tp, r.fp) == (sum(flagged), len(flagged) - sum(flagged))
        assert (r.fn, r.tn) == (pos - r.tp, len(rows) - pos - r.fp)
        assert r.recall == pytest.approx(r.tp / pos) and r.precision == pytest.approx(r.tp / (r.tp + r.fp))
        assert r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall or 1))
    one = detector_evaluation(frame, higher_is_worse=worse).first()
    sign = 1 if worse else -1
    pairs = [(sign * (a - b) > 0) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    assert one.auc == pytest.approx(sum(pairs) / len(pairs))
    assert one.best_f1 == pytest.approx(max(r.f1 for r in got.values()))
    assert got[one.best_threshold].f1 == pytest.approx(one.best_f1)
    assert one.tp == sum(y for s, y in rows if s >= 0.5)


def test_curve_of_nothing_and_of_one_kind(spark):
    schema = "anomaly_score double, label boolean, is_anomaly boolean"
    none = spark.createDataFrame([], schema)
    assert threshold_curve(none).count() == 0
    one = detector_evaluation(none).first()
    assert (one.tp, one.precision, one.auc) == (0, 0.0, None)
    only = spark.createDataFrame([(0.5, False, False)] * 3, schema)
    row = detector_evaluation(only).first()
    assert (row.tn, row.recall, row.auc) == (3, 0.0, 0.0)


GOOD = '10.0.0.1 - - [12/Oct/2024:06:25:24 +0000] "GET /a HTTP/1.1" 200 12 "-" "agent" 0.5'


@pytest.mark.parametrize("line,field,category", [
    ("junk", "address", "unexpected_characters"),
    (GOOD.replace("[", ""), "time", "malformed_timestamp"),
    (GOOD.replace("12/Oct", "99/Oct"), "time", "malformed_timestamp"),
    (GOOD.replace("GET /a", "GET"), "request", "invalid_url_format"),
    (GOOD.replace(" 200 ", " - "), "status", "missing_status_code"),
    (GOOD.replace(" 200 ", " 99999999999 "), "status", "missing_status_code"),
    (GOOD.replace(" 12 ", " - "), "size", "unexpected_characters"),
    (GOOD.replace(" 12 ", " 99999999999999999999 "), "size", "unexpected_characters"),
    (GOOD.replace('"-"', '"a"b"'), "agent", "unexpected_characters"),
    (GOOD, None, None), ("  " + GOOD, None, None),
])
def test_causes(spark, line, field, category):
    lines = spark.createDataFrame([("s", line)], "source string, value string")
    rows = parse_error_breakdown(parse_access_log(lines, on_bad_time="reject")).collect()
    assert [(r.field, r.category, r.error_count) for r in rows] == ([(field, category, 1)] if field else [])
