"""Shared storage and size checks used by the multi-pass operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A side is only broadcast when it was measured and is at most this large.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 * 1024 * 1024

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where that is unset one folder per application is made if everything runs in one
    process (``local``); on a cluster it is an error, as executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="logtide-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it back.

    Multi-pass algorithms start from this table, so a lost executor costs a re-read
    and never a re-parse of the raw logs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch_table(df: DataFrame, label: str, stored: bool = False):
    """``materialize`` for the length of a ``with`` block; ``stored`` input is used as it is."""
    if stored:
        yield df
        return
    table, path = materialize(df, label)
    try:
        yield table
    finally:
        delete_path(df.sparkSession, path)


def collect_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS):
    """Rows of ``df`` if there are at most ``max_rows``, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that comes in fewer partitions than there are cores.

    A few small files, or files that cannot be split, would leave the parsing of their
    lines to as many tasks. Inputs of cluster size have more partitions and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
