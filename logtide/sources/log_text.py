"""Access-log files as lines and as parsed rows.

Files should be splittable (plain or bzip2/zstd-seekable text). For streams they are either
moved into a folder whole, as Spark's file source reads a file once, or followed as they grow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import drop_undecodable, strip_blanks
from ..operators.parse import parse_access_log
from .growing import GrowingText


def source_of_path(by: str | Mapping[str, str] = "folder", path: Column | None = None) -> Column:
    """Name of the log a line came from: the folder of its file, the file, or as mapped.

    A mapping goes from a part of the path to the name, the first that fits counting; other
    files have a null name. By file, every rotated file of a log is a log of its own.
    """
    path = F.col("_metadata.file_path") if path is None else path
    if isinstance(by, Mapping):
        return F.coalesce(*[F.when(path.contains(part), F.lit(name))
                            for part, name in by.items()], F.lit(None).cast("string"))
    if by == "file":
        return F.substring_index(path, "/", -1)
    if by == "folder":
        return F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    raise ValueError(f"source must come from 'file' or 'folder', not {by!r}")


def clean_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Strip blanks around lines and drop those with nothing else."""
    return (lines.withColumn(value_col, _once(strip_blanks(F.col(value_col))))
            .filter(F.length(value_col) > 0))


def _once(value: Column) -> Column:
    """``value`` worked out once for each line, not again in each filter and column above it."""
    return F.explode(F.array(value))


def _with_source(raw: DataFrame, source: str | Mapping[str, str] | Column, modified_since=None) -> DataFrame:
    if modified_since is not None:
        raw = raw.filter(F.col("_metadata.file_modification_time")
                         >= F.lit(modified_since).cast("timestamp"))
    name = source if isinstance(source, Column) else source_of_path(source)
    return raw.select(name.alias("source"), _once(drop_undecodable(F.col("value"))).alias("value"))


def read_lines(spark: SparkSession, paths: str | Sequence[str],
               source: str | Mapping[str, str] | Column = "folder") -> DataFrame:
    """``(source, value)`` for the lines of one or many files; undecodable bytes dropped."""
    return clean_lines(_with_source(
        spark.read.text(paths if isinstance(paths, str) else list(paths)), source))


def read_log_batch(spark: SparkSession, paths: str | Sequence[str],
                   source: str | Mapping[str, str] | Column = "folder", **parse_options) -> DataFrame:
    """Read and parse whole files. See ``parse_access_log`` for the options."""
    return parse_access_log(read_lines(spark, paths, source), **parse_options)


def read_log_stream(spark: SparkSession, path: str, source: str | Mapping[str, str] | Column = "folder",
                    start_from_latest=None, max_files_per_trigger: int | None = None,
                    follow: bool = False, idle_seconds: float | None = None,
                    **parse_options) -> DataFrame:
    """The same as a stream over the files that arrive in a folder, or grow there.

    The checkpoint of the query remembers what was read. By default a file is read once, as it
    arrives, and ``start_from_latest`` is a time: files last modified before it, the history at
    the start of the collection, are skipped. With ``follow`` the files of a folder, or one file
    and what it is rotated to, are read on as they grow; a last line counts when it is ended,
    or after ``idle_seconds`` without a change. ``start_from_latest=True`` then begins
    behind what is there, and ``source`` is worked out from the path.
    """
    if follow:
        return parse_access_log(follow_lines(spark, path, source, bool(start_from_latest),
                                             idle_seconds), **parse_options)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = clean_lines(_with_source(reader.load(path), source, start_from_latest))
    return parse_access_log(lines, **parse_options)


def follow_lines(spark: SparkSession, path: str, source: str | Mapping[str, str] | Column = "folder",
                 start_from_latest: bool = False, idle_seconds: float | None = None) -> DataFrame:
    """``(source, value)`` for the lines of growing files, as a stream. See ``growing``."""
    spark.dataSource.register(GrowingText)
    reader = (spark.readStream.format(GrowingText.name()).option("path", path)
              .option("fromLatest", start_from_latest))
    if idle_seconds is not None:
        reader = reader.option("idleSeconds", idle_seconds)
    rows = reader.load()
    name = source if isinstance(source, Column) else source_of_path(source, F.col("path"))
    return clean_lines(rows.select(name.alias("source"), "value"))
