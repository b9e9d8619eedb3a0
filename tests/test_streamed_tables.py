"""Tables that streams append to: repeats, compaction, readers in between."""

import os
import re

import pytest
from pyspark.sql import functions as F

from logtide import sinks, sources
from logtide.schemas import LOGS_TABLE
from logtide.sinks import streamed


@pytest.fixture
def batches(logs):
    """The log in three parts that share days."""
    return [sinks.logs_table(logs.filter(F.col("log_id") % 3 == i)) for i in range(3)]


def ids(table):
    return sorted(r.raw_log for r in table.select("raw_log").collect())


def test_repeated_and_compacted_batches_are_there_once(spark, logs, batches, tmp_path):
    root = str(tmp_path / "logs")
    with pytest.raises(FileNotFoundError):
        streamed.streamed_table(spark, root)
    assert streamed.streamed_table(spark, root, LOGS_TABLE).count() == 0
    assert sinks.compact(spark, root) is None
    for _ in range(2):
        sinks.append_batch(batches[0], root, 0)
    one = ids(streamed.streamed_table(spark, root))
    assert one == ids(batches[0])
    assert sinks.compact(spark, root) == 1
    assert ids(streamed.streamed_table(spark, root)) == one
    sinks.append_batch(batches[0], root, 0)  # run again after it was taken in
    sinks.append_batch(batches[1], root, 1)
    reader = streamed.streamed_table(spark, root, LOGS_TABLE)
    two = sorted(one + ids(batches[1]))
    assert ids(reader) == two
    assert sinks.compact(spark, root) == 2 and sinks.compact(spark, root) is None
    assert ids(reader) == two  # a reader that began before the compaction
    sinks.append_batch(batches[2], root, 2)
    assert sinks.compact(spark, root, upto=1) is None
    assert sinks.compact(spark, root) == 3
    table = streamed.streamed_table(spark, root)
    assert ids(table) == ids(sinks.logs_table(logs)) and table.columns == LOGS_TABLE.names
    assert not os.path.exists(f"{root}/compacted/generation=1/event_date=2024-01-02")
    assert not any(n == "batch_id=0" for _, d, _ in os.walk(f"{root}/live") for n in d)
    files = [f for _, _, names in os.walk(f"{root}/compacted/generation=3") for f in names if f.endswith(".parquet")]
    assert len(files) == table.select("event_date").distinct().count()


def test_compaction_is_seen_whole_or_not_at_all(spark, batches, tmp_path, monkeypatch):
    root = str(tmp_path / "logs")
    for i in range(2):
        sinks.append_batch(batches[i], root, i)
    before = ids(streamed.streamed_table(spark, root))
    real = streamed._commit

    def fails(*_):
        raise OSError("lost before the commit")

    monkeypatch.setattr(streamed, "_commit", fails)
    with pytest.raises(OSError):
        sinks.compact(spark, root)
    assert ids(streamed.streamed_table(spark, root)) == before
    monkeypatch.setattr(streamed, "_commit", real)
    assert sinks.compact(spark, root) == 1
    assert ids(streamed.streamed_table(spark, root)) == before
    with pytest.raises(RuntimeError, match="two compactions"):
        streamed._commit(spark, root, {"generation": 1, "upto": 1, "days": {}})


def test_scans_prune_days(spark, batches, tmp_path):
    root = str(tmp_path / "logs")
    sinks.append_batch(batches[0], root, 0)
    sinks.compact(spark, root)
    sinks.append_batch(batches[1], root, 1)
    table = streamed.streamed_table(spark, root)
    scan = sources.scan_logs(table, "2024-01-05 00:00:00", "2024-01-06 12:00:00", 10 ** 6)
    plan = scan._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[.{0,200}", plan)
    assert len(filters) == 2 and all("event_date" in f for f in filters)
    expected = table.filter("timestamp between timestamp'2024-01-05' and timestamp'2024-01-06 12:00:00'")
    assert scan.count() == expected.count() > 0


def test_rejects_are_written_and_scanned(spark, tmp_path):
    from logtide.plans import access_log
    from samples import SF
    parsed, path = access_log.parsed(spark, SF), str(tmp_path / "rejects")
    sinks.write_rejects(parsed, path, ingested="2024-02-01 10:00:00")
    sinks.write_rejects(parsed.limit(0), path)
    found = sources.scan_rejects(spark.read.parquet(path), "2024-02-01", "2024-02-02", 10 ** 6)
    assert found.count() == parsed.filter("not parse_ok").count() > 0
    assert found.filter("length(line_start) > 100 or raw_line is null").count() == 0
