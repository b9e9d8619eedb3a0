"""Day-partitioned tables that a stream appends to, and that are compacted while it runs.

Rows of a micro-batch go to ``live/event_date=D/batch_id=B``, which a repeated micro-batch
replaces. Compaction gathers the days with new batches into even files of a new generation and
then commits it by putting one small file in place: it names the last batch taken in and
the generation of each day. Readers look at that file first, so they see a compaction whole or not
at all. What a commit replaces stays until the commit after, for readers that began before.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import LOGS_TABLE
from .tables import logs_table

_DAY = "event_date"


def append_batch(table: DataFrame, root: str, batch_id: int) -> None:
    """Put the rows of a micro-batch, with their ``event_date``, in place of what it put before."""
    (table.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .hint("rebalance", F.col(_DAY)).sortWithinPartitions(_DAY, "timestamp")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(_DAY, "batch_id").parquet(f"{root}/live"))


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _commits(spark: SparkSession, root: str) -> list[dict]:
    """Commits in order; each is one line of text in a file that was renamed into place."""
    fs, folder = _hadoop(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(folder)]
    names = [n for n in names if n.endswith(".json")]
    rows = spark.read.text(names).collect() if names else []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["generation"])


def _commit(spark: SparkSession, root: str, commit: dict) -> None:
    name = f"{root}/commits/{commit['generation']:010d}.json"
    fs, path = _hadoop(spark, name)
    _, draft = _hadoop(spark, f"{name}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(commit).encode()))
    stream.close()
    if not fs.rename(draft, path):  # another compaction was first
        raise RuntimeError(f"{name} exists: two compactions of one table ran at once")


def _live(spark: SparkSession, root: str, schema: StructType | None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(
            StructType([*schema.fields, StructField("batch_id", LongType())]))
        return reader.parquet(f"{root}/live")
    except AnalysisException:
        return None  # nothing was appended yet


def streamed_table(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The table as of its last commit and all batches since, each row once.

    Both parts are partitioned by ``event_date``, so scans of a time range read its days only.
    """
    commits = _commits(spark, root)
    last = commits[-1] if commits else {"upto": -1, "days": {}}
    live = _live(spark, root, schema)
    parts = []
    if live is not None:
        parts.append(live.filter(F.col("batch_id") > last["upto"]).drop("batch_id"))
    if last["days"]:
        paths = [f"{root}/compacted/generation={g}/{_DAY}={day}" for day, g in sorted(last["days"].items())]
        parts.append(spark.read.option("basePath", f"{root}/compacted").parquet(*paths).drop("generation"))
    if not parts:
        if schema is None:
            raise FileNotFoundError(f"{root} holds no table")
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(out.columns))
    return out


def compact(spark: SparkSession, root: str, upto: int | None = None) -> int | None:
    """Gather the batches up to ``upto`` (default: all) of every day that has new ones.

    Returns the generation that was committed, none if there was nothing to do. Run it from one
    place at a time; readers and the stream need not stop. ``upto`` must be a batch that is done.
    """
    live = _live(spark, root, None)
    commits = _commits(spark, root)
    last = commits[-1] if commits else {"upto": -1, "days": {}, "generation": 0}
    if live is None:
        return None
    fresh = live.filter(F.col("batch_id") > last["upto"])
    if upto is not None:
        fresh = fresh.filter(F.col("batch_id") <= upto)
    found = fresh.groupBy(_DAY).agg(F.max("batch_id").alias("b")).collect()  # a row per day
    if not found:
        return None
    upto = max(r["b"] for r in found) if upto is None else upto
    generation, days = last["generation"] + 1, sorted(str(r[_DAY]) for r in found)
    rows = fresh.filter(F.col("batch_id") <= upto).drop("batch_id")
    old = [f"{root}/compacted/generation={last['days'][d]}/{_DAY}={d}" for d in days if d in last["days"]]
    if old:
        rows = rows.unionByName(spark.read.option("basePath", f"{root}/compacted").parquet(*old)
                                .drop("generation").select(rows.columns))
    (rows.hint("rebalance", F.col(_DAY)).sortWithinPartitions(_DAY, "timestamp")
     .write.mode("overwrite").partitionBy(_DAY).parquet(f"{root}/compacted/generation={generation}"))
    _commit(spark, root, {"generation": generation, "upto": upto,
                          "days": {**last["days"], **dict.fromkeys(days, generation)}})
    _sweep(spark, root, last)
    return generation


def _sweep(spark: SparkSession, root: str, before: dict) -> None:
    """Remove what the commit ``before`` had already replaced."""
    fs, live = _hadoop(spark, f"{root}/live")
    for day in fs.listStatus(live):
        for batch in fs.listStatus(day.getPath()) if day.isDirectory() else ():
            name = batch.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) <= before["upto"]:
                fs.delete(batch.getPath(), True)
    fs, folder = _hadoop(spark, f"{root}/compacted")
    kept = set(before["days"].items())
    for generation in fs.listStatus(folder):
        number = int(generation.getPath().getName().split("=")[1])
        if number > before["generation"]:
            continue
        for day in fs.listStatus(generation.getPath()):
            name = day.getPath().getName()
            if name.startswith(f"{_DAY}=") and (name.split("=")[1], number) not in kept:
                fs.delete(day.getPath(), True)


def stream_logs(parsed: DataFrame, root: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Append a stream of parsed rows to a logs table."""
    writer = parsed.writeStream.foreachBatch(
        lambda batch, batch_id: append_batch(logs_table(batch), root, batch_id))
    return (writer.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_streamed_logs(spark: SparkSession, root: str) -> DataFrame:
    return streamed_table(spark, root, LOGS_TABLE)
