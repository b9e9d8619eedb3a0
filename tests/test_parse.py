from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtide.functions import (
    cosine_similarity, drop_undecodable, fixed_decimals, response_time_of_line, status_class,
    strip_blanks,
)
from logtide.operators.parse import (
    dead_letter, ingest_summary, parse_access_log, parse_stats, parsed_only,
)
from logtide.sources import clean_lines, read_lines, read_log_batch

GOOD = ('1.2.3.4 - bob [12/Oct/2024:06:25:24 +0900] "GET /a/b?x=1?y=2 HTTP/1.1" 200 234 '
        '"http://r/" "Mozilla/5.0 (X11)"')
COMMON = '1.2.3.4 - - [12/Oct/2024:06:25:24 +0000] "GET /a HTTP/1.1" 200 234'
INGEST = datetime(2030, 1, 1)


def parse(spark, line, **options):
    frame = spark.createDataFrame([(line,)], "value string")
    options.setdefault("ingest_time", INGEST)
    return parse_access_log(frame, **options).first()


def test_combined_line(spark):
    row = parse(spark, GOOD)
    assert row.parse_ok and row.timestamp == datetime(2024, 10, 11, 21, 25, 24)
    assert (row.ip, row.remote_user, row.method, row.url, row.url_path, row.protocol) == (
        "1.2.3.4", "bob", "GET", "/a/b?x=1?y=2", "/a/b", "HTTP/1.1")
    assert (row.status_code, row.body_bytes_sent) == (200, 234)
    assert (row.http_referer, row.user_agent) == ("http://r/", "Mozilla/5.0 (X11)")
    assert row.response_time is None and row.raw_line == GOOD


@pytest.mark.parametrize("tail, expected", [
    (" 0.234", 0.234), (" 1.2.3", None), ("", None), (" abc", None), (" 7", 7.0), (" ...", None),
    (" 0.5 ", 0.5), (" x 0.5", 0.5), ("0.5", None), (" .5", 0.5), (" 1e3", None), (" -1", None),
])
def test_response_time(spark, tail, expected):
    row = parse(spark, GOOD + tail)
    assert row.parse_ok and row.response_time == expected
    whole = spark.createDataFrame([(GOOD + tail,)], "value string").select(
        response_time_of_line(F.col("value"))).first()[0]
    assert whole == expected


def test_dashes(spark):
    row = parse(spark, '1.2.3.4 - - [12/Oct/2024:06:25:24 +0000] "GET / HTTP/1.1" 200 1 "-" "-"')
    assert row.parse_ok
    assert (row.remote_user, row.http_referer, row.user_agent) == (None, None, "-")


@pytest.mark.parametrize("line", [
    "junk", "", "   ", COMMON,
    GOOD.replace(" 234 ", " - "),
    GOOD.replace('"http://r/"', '"http://"r/"'),
    GOOD.replace(" 200 ", " 99999999999 "),
    "1.2.3.4 - -  [12/Oct/2024:06:25:24 +0000] \"GET / HTTP/1.1\" 200 1 \"-\" \"-\"",
    "x " + GOOD,
])
def test_rejected(spark, line):
    row = parse(spark, line)
    assert not row.parse_ok and row.ip is None and row.raw_line == line


def test_quote_inside_agent_truncates(spark):
    row = parse(spark, GOOD.replace('"Mozilla/5.0 (X11)"', '"Moz"illa"'))
    assert row.parse_ok and row.user_agent == "Moz"


def test_blanks_around_line(spark):
    assert parse(spark, f" \t {GOOD} 0.5  ").response_time == 0.5


def test_no_break_space_is_a_blank(spark):
    assert not parse(spark, GOOD.replace("/a/b", "/a\u00a0b")).parse_ok


def test_separator_characters_in_line(spark):
    row = parse(spark, GOOD.replace("/a/b", "/a\u0001s\u0002e\u0001").replace("bob", "b\u0002"))
    assert row.parse_ok
    assert (row.url_path, row.remote_user) == ("/a\u0001s\u0002e\u0001", "b\u0002")


def test_very_long_line(spark):
    agent = "x " * 200_000
    row = parse(spark, GOOD.replace("Mozilla/5.0 (X11)", agent) + " 0.5")
    assert row.parse_ok and row.user_agent == agent and row.response_time == 0.5
    common = parse(spark, COMMON + " y" * 200_000 + " 0.5", log_type="apache",
                   log_format="common")
    assert common.response_time == 0.5


@pytest.mark.parametrize("time, expected", [
    ("1/oct/2024:06:25:24 +0000", datetime(2024, 10, 1, 6, 25, 24)),
    ("12/Oct/2024:06:25:24 +05:30", datetime(2024, 10, 12, 0, 55, 24)),
    ("99/Oct/2024:06:25:24 +0000", None), ("12/Oct/2024:06:25:24", None), ("x y z", None),
])
def test_times(spark, time, expected):
    line = GOOD.replace("12/Oct/2024:06:25:24 +0900", time)
    assert parse(spark, line).timestamp == (expected or INGEST)
    strict = parse(spark, line, on_bad_time="reject")
    assert strict.parse_ok == (expected is not None) and strict.timestamp == expected


def test_common_format(spark):
    options = {"log_type": "apache", "log_format": "common"}
    row = parse(spark, COMMON, **options)
    assert row.parse_ok and (row.http_referer, row.user_agent) == ("-", "-")
    assert row.response_time is None
    assert parse(spark, COMMON + " 0.5", **options).response_time == 0.5
    combined = parse(spark, GOOD, **options)
    assert combined.parse_ok and (combined.http_referer, combined.user_agent) == ("-", "-")
    assert not parse(spark, COMMON, log_type="apache").parse_ok
    assert not parse(spark, COMMON, log_type="nginx", log_format="common").parse_ok


def test_format_per_row(spark):
    frame = spark.createDataFrame(
        [(1, "nginx", "common", GOOD), (2, "apache", "common", GOOD),
         (3, "apache", "combined", GOOD), (4, "apache", "common", COMMON + " 3"),
         (5, "nginx", "common", COMMON)], "id int, kind string, form string, value string")
    rows = {r.id: r for r in parse_access_log(
        frame, log_type=F.col("kind"), log_format=F.col("form")).collect()}
    assert [rows[i].user_agent for i in (1, 2, 3, 4, 5)] == [
        "Mozilla/5.0 (X11)", "-", "Mozilla/5.0 (X11)", "-", None]
    assert rows[2].http_referer == "-" and rows[3].http_referer == "http://r/"
    assert rows[4].response_time == 3.0 and not rows[5].parse_ok


def test_custom_pattern(spark):
    pattern = (r'(\S++) (\S++) \[([^\]]++)\] (\S++) (\S++) (\S++) (\d++) (\d++) '
               r'"([^"]*+)" "([^"]*+)"')
    row = parse(spark, '9.9.9.9 ann [12/Oct/2024:06:25:24 +0000] GET /q?z HTTP/2 204 0 "-" "ua"',
                pattern=pattern)
    assert row.parse_ok and (row.ip, row.url_path, row.status_code) == ("9.9.9.9", "/q", 204)


def test_stats_summary_and_rejects(spark):
    frame = parse_access_log(spark.createDataFrame(
        [("a", GOOD), ("a", "junk" * 100), ("b", GOOD)], "source string, value string"))
    stats = {r.source: r for r in parse_stats(frame).collect()}
    assert (stats["a"].parsed_count, stats["a"].error_count, stats["a"].success_rate) == (1, 1, 50)
    assert stats["b"].success_rate == 100
    assert tuple(ingest_summary(frame).first()) == (3, 2, 1)
    reject = dead_letter(frame).first()
    assert reject.raw_line == "junk" * 100 and reject.line_start == ("junk" * 100)[:100]
    assert parsed_only(frame).count() == 2
    empty = parse_stats(frame.limit(0), by=None).first()
    assert (empty.total_count, empty.success_rate) == (0, 0)


def test_read_files(spark, tmp_path):
    (tmp_path / "site1.log").write_bytes(GOOD.encode() + b"\n\n   \n" + b"junk\xff\n")
    (tmp_path / "site2.log").write_bytes(GOOD.replace("bob", "b\xff").encode("latin-1") + b" 0.5\n")
    rows = read_log_batch(spark, [str(tmp_path / f"site{i}.log") for i in (1, 2)],
                          source="file").collect()
    found = sorted((r.source, r.parse_ok, r.raw_line[:4]) for r in rows)
    assert found == [("site1.log", False, "junk"), ("site1.log", True, "1.2."),
                     ("site2.log", True, "1.2.")]
    assert [r.remote_user for r in rows if r.source == "site2.log"] == ["b"]


def test_rotated_files_are_one_log(spark, tmp_path):
    for site in ("one", "two"):
        (tmp_path / site).mkdir()
        for name in ("access.log", "access.log.1"):
            (tmp_path / site / name).write_text(GOOD + "\n")
    paths = [str(tmp_path / site) for site in ("one", "two")]
    by_folder = read_log_batch(spark, paths).groupBy("source").count().collect()
    assert {tuple(r) for r in by_folder} == {("one", 2), ("two", 2)}
    mapped = read_log_batch(spark, paths, source={"/one/": "shop"}).groupBy("source").count()
    assert {tuple(r) for r in mapped.collect()} == {("shop", 2), (None, 2)}


def test_clean_lines_and_undecodable(spark):
    frame = spark.createDataFrame([(" a b\t",), ("  ",), ("",), (" c\r",)], "value string")
    assert [r.value for r in clean_lines(frame).collect()] == ["a b", "c"]
    text = spark.sql("select cast(concat(cast('aé' as binary), x'ff', cast('b' as binary)) "
                     "as string) as t").select(drop_undecodable(F.col("t"))).first()[0]
    assert text == "aéb"


def test_status_class(spark):
    frame = spark.createDataFrame([("200",), ("404",), ("500",), ("x",), (None,)], "s string")
    assert [r[0] for r in frame.select(status_class(F.col("s"))).collect()] == [
        "ok", "client_error", "server_error", None, None]


def test_fixed_decimals_like_python(spark):
    import random
    rng = random.Random(1)
    values = [0.0, 0.125, 0.375, 3.125, 2.675, 6.965, 1.005, -2.5, -0.001, 12.5, 1e9 + 0.005,
              0.00005, 99.995, 99.999]
    values += [rng.randrange(10 ** 6) / 2000 for _ in range(500)]
    values += [rng.uniform(-1000, 1000) for _ in range(500)]
    values += [(rng.randrange(10 ** 5) / 100 + rng.randrange(10 ** 5) / 100) / 2
               for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", fixed_decimals(F.col("v"), 2).alias("a"), fixed_decimals(F.col("v"), 4).alias("b"))
    for row in frame.collect():
        assert (row.a, row.b) == (f"{row.v:.2f}", f"{row.v:.4f}")


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                                  "a array<double>, b array<double>")
    values = [r[0] for r in frame.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert values[0] == pytest.approx(0.5 ** 0.5) and values[1] == 0


def test_line_pattern_runs_once(spark):
    frame = parsed_only(parse_access_log(
        spark.createDataFrame([(GOOD,)], "value string"))).filter("status_code >= 200")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # Once for usual lines, and once in the other branch for lines with a separator.
    assert plan.count("regexp_replace(") == 2 and plan.count("*(1)") == plan.count("+- ") + 1


def test_blanks_are_stripped_as_by_the_pattern_alone(spark):
    ends = ["", " ", "\t", "\xa0", "\u3000", "\u2028", "\x1c", "\x00", "!", "~", "\x7f", "\xe9", "\u8a9e", "a b"]
    texts = [(a + b + c,) for a in ends for b in ("", "x", " y ", "é語") for c in ends] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    pattern = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert df.select(strip_blanks(F.col("t")).alias("a"), pattern.alias("b")).filter(
        "not a <=> b").count() == 0


def test_strip_pattern_is_for_lines_with_blanks_only(spark, tmp_path):
    """It stands in one place of the plan, behind a look at the first and last byte."""
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.log").write_text("x y\n \t\n  z \n")
    lines = read_lines(spark, str(tmp_path / "site"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "CASE WHEN" in plan.split("regexp_replace")[0].splitlines()[-1]
    assert sorted(map(tuple, lines.collect())) == [("site", "x y"), ("site", "z")]
