"""Tables that a stream writes, one folder per micro-batch.

A micro-batch that is run again after a failure replaces its folder, so each row is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def batch_path(out: str, table: str, batch_id: int) -> str:
    return f"{out}/{table}/batch_id={batch_id}"


def write_batch(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(out, table, batch_id))


def read_batches(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table written by the pipeline, over all micro-batches."""
    return spark.read.option("basePath", f"{out}/{table}").parquet(f"{out}/{table}")
