"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import stored

#: Parts to a unit, queries, results to a query.
SCALE = 1024
QUERY_STEP = 100
RESULTS = 10

# Bytes of a tile of queries and rows of a shard of candidates; shards merged at a time.
_TILE_BYTES = 32 << 20
_SHARD = 16384
_MERGE = 16
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, width, vec)`` with whole-number components, without unusable vectors."""
    value = F.col("embedding").cast("array<double>")
    usable = (F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
              & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x)
                         & (F.abs(x) < float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long"), "embedding").where(usable)
            .select("vec_id", F.size("embedding").alias("width"),
                    F.transform(value, lambda x: _floor(x)).alias("vec")))


def _floor(x):
    # Doubles from 2**53 on are whole numbers, which a long need not hold.
    y = x * F.lit(float(SCALE))
    return F.when(F.abs(y) < _EXACT, F.floor(F.when(F.abs(y) < _EXACT, y)).cast("double")).otherwise(y)


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond a long they stop at its limits."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0))
    if top * max(1, queries.shape[1]) < _EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in queries]
    other = [[int(v) for v in row] for row in shard]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, s, strict=True))))
                      for s in other] for q in whole], np.int64).reshape(len(queries), len(shard))


def tile_best(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray,
              shard: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best ``k`` of a shard for each query: (row of the query, candidate's id, score)."""
    order = np.argsort(ids, kind="stable")
    rows, ids, shard, found = rows[order], ids[order], shard[order], []
    for lo in range(0, len(queries), 256):
        for q, row in zip(query_rows[lo:lo + 256], scores(queries[lo:lo + 256], shard), strict=True):
            allowed = np.flatnonzero(rows != q)
            if len(allowed) > k:
                least = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
                allowed = allowed[row[allowed] >= least]
            best = allowed[np.argsort(-row[allowed].astype(object) if row.min(initial=0) == -_LONG - 1
                                      else -row[allowed], kind="stable")[:k]]
            found += [(int(q), int(ids[i]), int(row[i])) for i in best]
    return found


def top_k(vectors: DataFrame, k: int = RESULTS, step: int = QUERY_STEP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` other rows of each query.

    Queries are the rows whose ``vec_id`` is divisible by ``step``. Ties go to the smaller id;
    with fewer candidates all are returned. Null vectors, and those that hold a null or a
    non-finite value, take no part, nor do rows without an id; a query meets only
    vectors of its own width. Rows with one ``vec_id`` are rows of their own: each is a candidate
    of every other, and each is a query if its id is. No rows give no rows; other columns are
    not read.

    Rows are dealt into query tiles and shards of bounded size by the hash of their number, every
    tile meets every shard in a task of its own, which returns the best ``k`` per query, and
    lists of ``_MERGE`` shards are merged at a time until one is left.
    """
    rows = stored(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % step == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"),
                     F.max("width").alias("width")).first()
    tile_rows = max(1, _TILE_BYTES // (8 * max(1, sizes["width"] or 1)))
    tiles, shards = -(-sizes["q"] // tile_rows) or 1, -(-sizes["n"] // _SHARD) or 1
    key = F.xxhash64("row", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = (rows.where(is_query)
             .select("width", F.pmod(key, F.lit(tiles)).cast("int").alias("tile"),
                     every(shards).alias("shard"), "row", "vec_id", "vec", F.lit(True).alias("query"))
             .union(rows.select("width", every(tiles).alias("tile"),
                                F.pmod(key, F.lit(shards)).cast("int").alias("shard"),
                                "row", "vec_id", "vec", F.lit(False).alias("query"))))

    def product(group: pd.DataFrame) -> pd.DataFrame:
        is_q = group["query"].to_numpy(bool)
        numbers, ids = group["row"].to_numpy(np.int64), group["vec_id"].to_numpy(np.int64)
        width = int(group["width"].iloc[0])
        matrix = np.stack(group["vec"].to_list()).astype(float).reshape(len(group), width)
        found = tile_best(numbers[is_q], matrix[is_q], numbers[~is_q], ids[~is_q], matrix[~is_q], k)
        out = pd.DataFrame(found, columns=["query", "vec_id", "score"], dtype="int64")
        name = dict(zip(numbers[is_q].tolist(), ids[is_q].tolist(), strict=True))
        out["query_id"] = out["query"].map(name).astype("int64") if len(out) else out["query"]
        out["shard"] = int(group["shard"].iloc[0])
        return out[["query", "query_id", "vec_id", "score", "shard"]]

    best = (sides.groupBy("width", "tile", "shard")
            .applyInPandas(product, "query long, query_id long, vec_id long, score long, shard int"))
    order = [F.desc("score"), "vec_id"]
    while True:
        group = (F.col("shard") / _MERGE).cast("int")
        place = F.row_number().over(Window.partitionBy("query", "group").orderBy(*order))
        best = (best.withColumn("group", group).withColumn("rank", place).where(F.col("rank") <= k)
                .select("query", "query_id", "rank", "vec_id", "score", F.col("group").alias("shard")))
        shards = -(-shards // _MERGE)
        if shards <= 1:
            return best.select("query_id", "rank", "vec_id", "score")
