"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

The words of a text fall into buckets. Counts of all documents and of all target texts give
each bucket a gain, and the array of gains scores whole texts. Documents are drawn by score
plus Gumbel noise that follows from their id.

The order is made by stable counting-sort passes from the least to the most significant
digit of the key (score falling, id rising). A pass counts the digits of each
chunk of rows, prefix sums over (digit, chunk) tell where each chunk's rows of a digit go, and
the destinations are the chunks of the next pass. After the last pass they are the ranks.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, stored, utf8

#: Buckets, words a document needs, percentage drawn, seed, parts to a unit.
BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = "2024:"
SCALE = 1000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Bits of a digit, and rows of a chunk.
DIGIT_BITS, CHUNK_ROWS = 11, 1 << 14

_REMEMBERED = 300_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(utf8(text).lower())


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class _Remembered(dict):
    """A value for each word, computed once while there is room."""

    def __init__(self, value):
        super().__init__()
        self._value = value

    def __missing__(self, word):
        found = self._value(word)
        if len(self) >= _REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def histogram(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column ``text``: one row per task and bucket."""
    def task(batches):
        counts = np.zeros(BUCKETS, np.int64)
        known = _Remembered(bucket)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = Counter(words(text))
                if found:
                    counts += np.bincount([known[w] for w in found], list(found.values()),
                                          minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(counts)
        yield {"bucket": pa.array(used, pa.int64()), "n": pa.array(counts[used])}

    out = np.zeros(BUCKETS, np.int64)
    for row in (arrow_pass(texts.select("text"), task, "bucket long, n long")
                .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log-ratio of smoothed shares, target over source."""
    all_s, all_t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t)))
                     for s, t in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise of an id in floored thousandths; a null id counts as no digits."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    u = (int(digest[:8], 16) + 0.5) / 4294967296
    return math.floor(-SCALE * math.log(-math.log(u)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_features, weight, score, chunk, place)``; the last two number the rows."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def task(batches):
        values = shipped.value.tolist()
        known = _Remembered(lambda w: values[bucket(w)])
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                found = [known[w] for w in words(text)]
                weight = sum(found) // len(found) if found else 0
                rows.append((i, len(found), weight, weight + noise(i),
                             part << 32 | place // CHUNK_ROWS, place % CHUNK_ROWS))
                place += 1
            yield dict(zip(("doc_id", "n_features", "weight", "score", "chunk", "place"),
                           map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True))

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, n_features long, weight long, score long, chunk long, place long")


def _digits(ranges: list[tuple[int, int, bool]], bits: int) -> list[tuple[int, int | None, int]]:
    """``(column, shift, bits)`` of each digit, least significant first.

    ``ranges`` are least and greatest value of each column, and whether it has nulls: they are told
    apart by one more digit, whose shift is none.
    """
    out: list[tuple[int, int | None, int]] = []
    for column in reversed(range(len(ranges))):
        low, high, nulls = ranges[column]
        width = (high - low).bit_length()
        out += [(column, at, min(bits, width - at)) for at in range(0, width, bits)]
        out += [(column, None, 1)] if nulls else []
    return out or [(0, None, 1)]


def _counter(name: str, falling: bool, low: int, high: int, shift: int | None, width: int):
    """Adds to a chunk the digit of each row, and how many rows of that digit come before it."""
    def digits(held):
        if shift is None:
            return held.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        # Differences of longs may need all 64 bits, which unsigned arithmetic has.
        value = held.fill_null(low).to_numpy().view(np.uint64)
        edge = np.array([high if falling else low], np.int64).view(np.uint64)[0]
        rank = edge - value if falling else value - edge
        return ((rank >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def count(table):
        table = table.sort_by("place")
        digit = digits(pa.concat_arrays(table.column(name).chunks))
        order = np.argsort(digit, kind="stable")
        size = np.bincount(digit, minlength=1 << width)
        before = np.empty(len(digit), np.int64)
        before[order] = np.arange(len(digit)) - np.repeat(np.cumsum(size) - size, size)
        return (table.append_column("digit", pa.array(digit))
                .append_column("before", pa.array(before)))

    return count


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT_BITS,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with their ``position`` (from 0) in the order of ``keys`` instead of
    ``chunk`` and ``place``, by least-significant-digit radix sort.

    ``keys`` are long columns and whether they fall; nulls come last. ``chunk`` and ``place``
    number the rows; equal keys keep that order. Digits span the range
    that a column has in ``rows``, so a pass is made only for bits that are in use. No task
    holds more rows than a chunk, and every pass starts from a stored table.
    """
    columns = [c for c in rows.columns if c not in ("chunk", "place")]
    names = [name for name, _ in keys]
    one = rows.agg(F.count("*"), *[f(k) for k in names for f in (F.count, F.min, F.max)]).first()
    ranges = [(one[3 * i + 2] or 0, one[3 * i + 3] or 0, one[3 * i + 1] < one[0])
              for i in range(len(keys))]
    moved = rows.select(*columns, "chunk", "place")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.schema)
    for column, shift, width in _digits(ranges, bits):
        count = _counter(*keys[column], *ranges[column][:2], shift, width)
        counted = stored(moved.groupBy("chunk").applyInArrow(
            count, f"{fields}, digit long, before long"), "radix-counted")
        sizes = stored(counted.groupBy("digit", "chunk").agg(F.count("*").alias("size")),
                       "radix-sizes")
        first, total = [], 0
        for d, size in sorted(map(tuple, sizes.groupBy("digit").agg(F.sum("size")).collect())):
            first.append((d, total))  # at most 2 ** bits rows
            total += size
        base = rows.sparkSession.createDataFrame(first, "digit long, base long")
        earlier = Window.partitionBy("digit").orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        begin = (sizes.join(F.broadcast(base), "digit")
                 .select("digit", "chunk", (F.col("base") + F.coalesce(
                     F.sum("size").over(earlier), F.lit(0))).alias("begin")))
        to = F.col("begin") + F.col("before")
        moved = counted.join(begin, ["digit", "chunk"]).select(
            *columns, F.floor(to / chunk_rows).alias("chunk"), (to % chunk_rows).alias("place"))
    moved = stored(moved, "radix-ranked")
    return moved.select(*columns, (F.col("chunk") * chunk_rows + F.col("place")).alias("position"))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``.

    ``rank`` numbers the documents drawn: of those with at least ``LEAST_WORDS`` words the
    ``DRAWN_PERCENT`` percent (rounded down) of the highest scores, ties to the smaller id, null
    ids last; the others have none. A null text has no words; a text without words has weight 0.
    Repeated rows count and are ranked each by itself, in the order in which they are read.
    Other columns are not read; no rows give no rows, and an empty target all the same scores.
    """
    rows = stored(scored(docs, gains(histogram(docs), histogram(target))), "scored")
    able = F.col("n_features") >= LEAST_WORDS
    order = ranked(rows.where(able), [("score", True), ("doc_id", False)])
    quota = rows.where(able).count() * DRAWN_PERCENT // 100
    out = ["doc_id", "n_features", "weight", "score"]
    rank: Column = F.when(F.col("position") < quota, F.col("position") + 1)
    return (order.select(*out, rank.alias("rank"))
            .unionByName(rows.where(~able).select(*out, F.lit(None).cast("long").alias("rank"))))
