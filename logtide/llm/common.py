"""What the operators share: reading tables, shared storage, Arrow passes over texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from logtide.session import materialize

#: Rows of a few numbers that Spark may broadcast: some 30 MB as a hash table in the driver.
BROADCAST_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Passes that start from the stored table never repeat what made it, also when an
    executor is lost.
    """
    return materialize(df, label)[0]


def counted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of a join, which broadcasts neither side if ``rows``, its count, is large.

    Spark sizes a table by the bytes of its files, where a number takes a tenth of what it takes
    in a hash table, and knows nothing of rows that a pass or an explode adds.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def arrow_pass(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
               schema: str) -> DataFrame:
    """``mapInArrow`` for a task that yields dicts of columns in the order of ``schema``."""
    types = _arrow_schema(schema)

    def run(batches):
        for columns in task(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, f.type)
                 for v, f in zip(columns.values(), types, strict=True)], schema=types)

    return df.mapInArrow(releasing(run), schema)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives back the memory that it no longer uses.

    Python workers serve task after task; what one has kept for its words would count against the
    executor's memory while the next stages run.
    """
    def released(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # other C libraries have no such call
            pass

    return released


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(StructType.fromDDL(schema))


def utf8(text: str | None) -> bytes:
    """Bytes of a text; a null counts as empty, a lone surrogate as its three bytes."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
