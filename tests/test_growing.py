"""Log files that grow: what a stream reads of them, trigger by trigger."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from logtide.plans import access_log
from logtide.sources import growing, read_log_batch, read_log_stream
from samples import SF


class Follower:
    """One query, run to the end of what is there again and again."""

    def __init__(self, spark, path, out, **options):
        self.spark, self.path, self.out, self.options = spark, str(path), str(out), options

    def run(self):
        rows = growing_rows(self.spark, self.path, **self.options)
        (rows.writeStream.format("parquet").option("path", f"{self.out}/rows")
         .option("checkpointLocation", f"{self.out}/check").trigger(availableNow=True).start()
         .awaitTermination())
        return sorted(r.value for r in self.spark.read.schema("value string").parquet(
            f"{self.out}/rows").collect())


def growing_rows(spark, path, **options):
    spark.dataSource.register(growing.GrowingText)
    reader = spark.readStream.format("growing_text").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select("value")


def append(path, text):
    with open(path, "ab") as file:
        file.write(text.encode() if isinstance(text, str) else text)


def test_appended_halves_truncated_and_rotated(spark, tmp_path):
    folder = tmp_path / "logs" / "site"
    folder.mkdir(parents=True)
    log, follower = folder / "access.log", Follower(spark, tmp_path / "logs", tmp_path / "out")
    append(log, "one\ntwo\nthr")
    assert follower.run() == ["one", "two"]
    assert follower.run() == ["one", "two"]  # nothing new
    append(log, "ee\n")
    append(folder / "error.log", "e1\n")
    assert follower.run() == ["e1", "one", "three", "two"]
    append(log, "four\nfi")
    os.rename(log, folder / "access.log.1")  # rotated between two triggers
    append(folder / "access.log.1", "ve\n")
    append(log, "six\n")
    so_far = ["e1", "five", "four", "one", "six", "three", "two"]
    assert follower.run() == so_far
    os.rename(folder / "access.log.1", folder / "access.log.2")
    os.rename(log, folder / "access.log.1")
    append(folder / "access.log.1", "seven\n")
    append(log, "eight\n")
    so_far = sorted([*so_far, "seven", "eight"])
    assert follower.run() == so_far
    with open(log, "w") as file:  # cut short and begun again
        file.write("nine\nten\neleven\n")
    so_far = sorted([*so_far, "nine", "ten", "eleven"])
    assert follower.run() == so_far
    with open(log, "w") as file:  # copied, then cut short
        file.write("")
    append(folder / "access.log.3", "nine\nten\neleven\ntwelve\n")
    append(log, "thirteen\n")
    assert follower.run() == sorted([*so_far, "twelve", "thirteen"])


def test_last_line_without_an_end(spark, tmp_path):
    log = tmp_path / "access.log"
    append(log, "a\nb")
    os.utime(log, (1_700_000_000, 1_700_000_000))
    assert Follower(spark, log, tmp_path / "waits", idleSeconds=10 ** 10).run() == ["a"]
    follower = Follower(spark, log, tmp_path / "reads")
    assert follower.run() == ["a", "b"]
    append(log, "\nc\n")
    assert follower.run() == ["", "a", "b", "c"]


def test_from_latest_and_one_file(spark, tmp_path):
    log = tmp_path / "access.log"
    append(log, "old\n")
    append(tmp_path / "access.log.1", "older\n")
    append(tmp_path / "other.log", "other\n")
    one = Follower(spark, log, tmp_path / "one")
    assert one.run() == ["old"]
    reader = growing.GrowingTextReader({"path": str(log), "fromLatest": "true"})
    start = reader.initialOffset()
    append(log, "new\n")
    os.rename(log, tmp_path / "access.log.0")
    append(log, "newer\n")
    parts = reader.partitions(start, reader.latestOffset())
    got = sorted(v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist())
    assert got == ["new", "newer"] and one.run() == ["new", "newer", "old"]


def test_planned_ranges_survive_a_rotation(tmp_path):
    log = tmp_path / "access.log"
    append(log, "a\nb\n")
    reader = growing.GrowingTextReader({"path": str(tmp_path)})
    parts = reader.partitions({}, reader.latestOffset())
    os.rename(log, tmp_path / "access.log.1")
    append(log, "c\n")
    assert [v for b in reader.read(parts[0]) for v in b.column(0).to_pylist()] == ["a", "b"]
    os.remove(tmp_path / "access.log.1")
    with pytest.raises(FileNotFoundError, match="bytes 0 to 4"):
        list(reader.read(parts[0]))


@pytest.mark.parametrize("split,read", [(1, 1), (7, 3), (64, 16), (1 << 20, 1 << 20)])
def test_ranges_hold_each_line_once(tmp_path, monkeypatch, split, read):
    monkeypatch.setattr(growing, "READ_BYTES", read)
    monkeypatch.setattr(growing, "MARK_BYTES", 8)
    rng = random.Random(split)
    lines = ["".join(rng.choice("ab é\r") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(60)]
    data = ("\n".join(lines) + "\nhalf").encode()
    log = tmp_path / "a.log"
    append(log, data)
    reader = growing.GrowingTextReader({"path": str(tmp_path), "splitBytes": split})
    parts = reader.partitions({}, reader.latestOffset())
    got = [x.decode() for p in parts for some in growing._lines(io.BytesIO(data), p) for x in some]
    assert got == lines


def test_undecodable_bytes_are_dropped(tmp_path):
    append(tmp_path / "a.log", b"x\xffy\xc3\xa9\n")
    reader = growing.GrowingTextReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions({}, reader.latestOffset())
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == ["xyé"]


def test_followed_log_equals_batch(spark, tmp_path):
    rows = [r.value for r in access_log.lines(spark, SF).orderBy("log_id").collect()]
    folder = tmp_path / "in" / "site"
    folder.mkdir(parents=True)
    for i in range(3):
        append(folder / "access.log", "\n".join(rows[i * 300:(i + 1) * 300]) + "\n")
        stream = read_log_stream(spark, str(tmp_path / "in"), follow=True, on_bad_time="reject")
        (stream.writeStream.format("parquet").option("path", str(tmp_path / "rows"))
         .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
         .awaitTermination())
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "rows"))
    expected = read_log_batch(spark, str(folder), on_bad_time="reject")
    assert got.count() == expected.count() == 900
    assert got.exceptAll(expected).count() == 0 and got.filter(F.col("source") == "site").count() == 900
