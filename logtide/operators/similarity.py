"""Patterns of windows before past failures, and the nearest pattern of a vector."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..constants import PATTERN_MINUTES, PATTERN_NEIGHBOURS, PATTERN_SIMILARITY
from ..functions.vectors import feature_vector, flatten_pattern
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, materialize
from .ranking import DIGITS, top_k, unit_rows

PATTERN_COLUMNS = ("pattern_id", "source", "failure_time", "minutes_before", "pattern")


def with_vector(features: DataFrame, name: str = "features") -> DataFrame:
    return features.withColumn(name, feature_vector(features.columns))


def historical_failure_patterns(features: DataFrame, failures: DataFrame,
                                window_minutes: int = PATTERN_MINUTES,
                                vector_col: str | None = None) -> DataFrame:
    """One pattern per failure: the windows in the minutes before it, in time order.

    ``failures`` has ``source`` and ``failure_time``; one without such windows is left out.
    The interval join is an equi-join: time is cut into buckets as long as the look-back,
    so an interval touches two buckets and a bucket holds a bounded number of windows.
    """
    length = window_minutes * 60_000_000
    rows = features if vector_col else with_vector(features, "_vec")
    vector = vector_col or "_vec"

    def bucket(micros: str) -> str:
        return f"(({micros}) - pmod({micros}, {length}L)) div {length}L"

    at = F.unix_micros("timestamp").alias("_at")
    windows = rows.select("source", at, F.col(vector).alias("_v")).withColumn(
        "_bucket", F.expr(bucket("_at")))
    # A failure reported many times is one failure, and one group below.
    wanted = failures.select("source", "failure_time").distinct().withColumn(
        "_end", F.unix_micros("failure_time"))
    wanted = wanted.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        F.expr(bucket(f"_end - {length}L")), F.expr(bucket("_end"))))))
    inside = (F.col("_at") >= F.col("_end") - length) & (F.col("_at") < F.col("_end"))
    joined = wanted.join(windows, ["source", "_bucket"]).filter(inside)
    # A group is one failure: as many windows as fit into the look-back.
    grouped = joined.groupBy("source", "failure_time").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_w"))
    return add_failure_pattern(grouped.select(
        "source", "failure_time", flatten_pattern(F.col("_w._v")).alias("pattern")),
        window_minutes)


def add_failure_pattern(patterns: DataFrame, minutes_before: int = PATTERN_MINUTES,
                        existing: DataFrame | None = None) -> DataFrame:
    """Vectors as rows of the patterns table, appended to ``existing`` if given.

    The id is derived from the content, so that it is the same in every run.
    """
    named = patterns.withColumn("minutes_before", F.lit(minutes_before))
    for column, kind in (("source", "string"), ("failure_time", "timestamp")):
        if column not in named.columns:
            named = named.withColumn(column, F.lit(None).cast(kind))
    if "pattern_id" not in named.columns:
        named = named.withColumn("pattern_id", F.concat_ws(
            "/", "source", F.date_format("failure_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.sha2(F.to_json("pattern"), 256)))
    named = named.select(*PATTERN_COLUMNS)
    return named if existing is None else existing.select(*PATTERN_COLUMNS).unionByName(named)


def rolling_pattern(features: DataFrame, seconds: int = PATTERN_MINUTES * 60,
                    vector_col: str | None = None) -> DataFrame:
    """For each window the flattened vectors of the windows in the ``seconds`` before it.

    Partitioned by source and stretch of time, each stretch preceded by a copy of the
    look-back it needs, so that one busy source is spread over many tasks.
    """
    rows = features if vector_col else with_vector(features, "_vec")
    vector = vector_col or "_vec"
    stretch = seconds * 512
    at = F.unix_seconds("timestamp")
    own = F.expr(f"(_at - pmod(_at, {stretch}L)) div {stretch}L")
    reach = F.expr(f"(_at + {seconds}L - pmod(_at + {seconds}L, {stretch}L)) div {stretch}L")
    keyed = rows.withColumn("_at", at).withColumn("_own", own)
    copies = keyed.withColumn("_stretch", F.explode(F.array_distinct(F.array("_own", reach))))
    before = (Window.partitionBy("source", "_stretch").orderBy("_at")
              .rangeBetween(-seconds, -1))
    packed = F.sort_array(F.collect_list(F.struct("timestamp", vector)).over(before))
    return (copies.withColumn("_w", packed).filter(F.col("_own") == F.col("_stretch"))
            .withColumn("window_count", F.size("_w"))
            .withColumn("pattern", F.flatten(F.col(f"_w.{vector}")))
            .drop("_at", "_own", "_stretch", "_w", "_vec"))


#: Vectors to which patterns are dealt by angle, at most, and their bytes.
CENTRES, CENTRE_BYTES = 256, 16 << 20
_SLACK = 1e-7
_BLOCK_ROWS = 256  # queries that are worth a task of their own
_PART_ROWS = 2048  # patterns that are
_BLOCK_BYTES = 32 << 20  # of queries that a task holds
_HOME_BYTES = 1 << 20  # of patterns from which a first bound is taken
_PIECE_ROWS = 1024  # patterns compared at a time, at least, where centres change
_CELLS = 2_000_000  # similarities held at a time
_TILED = ("_row bigint, _size int, _centre int, _part bigint, _block int, _query boolean, "
          "_own {id}, _id {id}, _vec {vec}")


def _stacked(vectors: pd.Series) -> np.ndarray:
    return unit_rows(np.stack(vectors.to_list()).astype(float))


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _kind(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


class _Clusters:
    """Patterns by length and nearest centre: how many, and the widest angle to the centre.

    Zero vectors have no direction: they form a cluster of their own that every query meets.
    """

    def __init__(self, centres: dict[int, np.ndarray], tile_bytes: int):
        self.centres, self.tile_bytes = centres, tile_bytes
        self.found: dict[tuple[int, int], tuple[int, float]] = {}

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre (-1 for none) and angle to it of vectors of one length."""
        centres = self.centres.get(units.shape[1])
        if centres is None:
            return np.full(len(units), -1), np.full(len(units), np.pi)
        angle = _angles(units, centres)
        best = np.argmin(angle, axis=1)
        zero = ~units.any(axis=1)
        return (np.where(zero, -1, best),
                np.where(zero, np.pi, angle[np.arange(len(units)), best]))

    def parts(self, size: int, centre: int) -> int:
        count, _ = self.found.get((size, centre), (0, 0.0))
        return max(1, -(-count * (8 * size + 64) // self.tile_bytes))

    def reach(self, units: np.ndarray, least: np.ndarray, some: list[int]) -> np.ndarray:
        """Rows of ``units`` that can reach their ``least`` with a pattern of one of the centres ``some``."""
        size = units.shape[1]
        if size not in self.centres or min(some) < 0:
            return np.arange(len(units))
        radius = np.array([self.found[size, c][1] for c in some])
        far = np.maximum(0.0, _angles(units, self.centres[size][some]) - radius).min(axis=1)
        far[~units.any(axis=1)] = 0.0
        return np.flatnonzero(np.cos(far) + _SLACK >= least)

    def allowed(self, units: np.ndarray, least: np.ndarray) -> list[list[int]]:
        """Centres whose patterns can reach the similarity ``least`` with each vector."""
        size = units.shape[1]
        held = [c for s, c in self.found if s == size]
        far = np.zeros((len(units), len(held)))
        if size in self.centres and held:
            angle = _angles(units, self.centres[size])
            for i, c in enumerate(held):
                if c >= 0:
                    far[:, i] = np.maximum(0.0, angle[:, c] - self.found[size, c][1])
            far[~units.any(axis=1)] = 0.0
        ok = np.cos(far) + _SLACK >= least[:, None]
        return [[c for c, yes in zip(held, row, strict=True) if yes] for row in ok]


def _clusters(patterns: DataFrame, tile_bytes: int) -> _Clusters:
    """Centres (a bounded sample, the lowest hashes) and the clusters around them."""
    bytes_in_all = pattern_bytes(patterns)
    centres: dict[int, np.ndarray] = {}
    if bytes_in_all > tile_bytes:
        widest = patterns.agg(F.max(F.size("pattern"))).first()[0]
        most = max(1, min(CENTRES, CENTRE_BYTES // (8 * widest + 64)))
        rows = (patterns.select("pattern", F.xxhash64("pattern_id").alias("_h")).orderBy("_h").limit(most)
                .toPandas())
        for size, part in rows.groupby(rows["pattern"].map(len)):
            units = _stacked(part["pattern"])
            units = units[units.any(axis=1)]
            if len(units):
                centres[int(size)] = units
    clusters = _Clusters(centres, tile_bytes)

    def measure(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["pattern"].map(len)):
                centre, angle = clusters.nearest(_stacked(part["pattern"]))
                yield pd.DataFrame({"size": int(size), "centre": centre, "angle": angle}).groupby(
                    ["size", "centre"], as_index=False).agg(n=("angle", "size"), angle=("angle", "max"))

    sizes = (patterns.select("pattern").mapInPandas(measure, "size int, centre int, n bigint, angle double")
             .groupBy("size", "centre").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")))
    # A row for each centre and each length, of which there are few.
    clusters.found = {(r["size"], r["centre"]): (r["n"], r["angle"]) for r in sizes.collect()}
    return clusters


def _dealt(patterns: DataFrame, clusters: _Clusters, id_type: str) -> DataFrame:
    """Every pattern in its tile."""
    def task(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["pattern"].map(len)):
                centre, _ = clusters.nearest(_stacked(part["pattern"]))
                parts = np.array([clusters.parts(int(size), int(c)) for c in centre])
                yield pd.DataFrame({
                    "_row": -1, "_size": int(size), "_centre": centre,
                    "_part": part["_h"].to_numpy() % parts, "_query": False, "_own": None,
                    "_id": part["pattern_id"], "_vec": part["pattern"]})

    kinds = _TILED.format(id=id_type, vec=_kind(patterns, "pattern")).replace("_block int, ", "")
    hashed = patterns.withColumn("_h", F.xxhash64("pattern_id") % (1 << 40))
    if clusters.centres:
        return hashed.mapInPandas(task, kinds)
    return hashed.select(
        F.lit(-1).cast("bigint").alias("_row"), F.size("pattern").alias("_size"), F.lit(-1).alias("_centre"),
        F.lit(0).cast("bigint").alias("_part"), F.lit(False).alias("_query"),
        F.lit(None).cast(id_type).alias("_own"), F.col("pattern_id").alias("_id"), F.col("pattern").alias("_vec"))


def _asked(queries: DataFrame, clusters: _Clusters, blocks: int, id_type: str, home: bool) -> DataFrame:
    """Every query in the tiles it has to meet; with ``home`` in one tile near it only.

    The search itself takes the home tiles from here; how many tiles queries meet tells what the
    bounds are worth.
    ``queries`` has ``_row``, ``_own``, ``_vec`` and ``_least``, a similarity that its last
    result will reach at least, or null.
    """
    def task(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["_vec"].map(lambda v: 0 if v is None else len(v))):
                size = int(size)
                if not any(s == size for s, _ in clusters.found):
                    continue
                units = _stacked(part["_vec"])
                if home:
                    centre, _ = clusters.nearest(units)
                    at, tile = np.arange(len(part)), np.array([(c, 0) for c in centre])
                else:
                    least = part["_least"].fillna(-2.0).to_numpy(float)
                    pairs = [(i, c, p) for i, some in enumerate(clusters.allowed(units, least))
                             for c in some for p in range(clusters.parts(size, c))]
                    table = np.array(pairs, np.int64).reshape(-1, 3)
                    at, tile = table[:, 0], table[:, 1:]
                own = part.iloc[at]
                yield pd.DataFrame({
                    "_row": own["_row"].to_numpy(), "_size": size, "_centre": tile[:, 0], "_part": tile[:, 1],
                    "_block": own["_row"].to_numpy() % blocks, "_query": True,
                    "_own": own["_own"].to_numpy(), "_id": None, "_vec": own["_vec"].to_numpy()})

    return queries.mapInPandas(task, _TILED.format(id=id_type, vec=_kind(queries, "_vec")))


def _compared(asked: DataFrame, dealt: DataFrame, k: int, id_type: str, tiles: int | None = None) -> DataFrame:
    """``(_row, pattern_id, similarity, rank)``: the best ``k`` of the tiles that a query met.

    ``tiles`` is how many there can be at most, where known; the names of a few go to all tasks.
    """
    tile = ["_size", "_centre", "_part", "_block"]

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["_query"].to_numpy(bool)
        q, table = group[asks], group[~asks].sort_values("_id", ignore_index=True)
        rows, ids, sims, order = [], [], [], []
        if len(q) and len(table):
            names = table["_id"].to_numpy()
            skip = q["_own"].to_numpy() if q["_own"].notna().any() else None
            for row, found, values, ranked in top_k(_stacked(q["_vec"]), _stacked(table["_vec"]), names,
                                                    k, skip):
                rows += [int(q["_row"].iloc[row])] * len(found)
                ids += names[found].tolist()
                sims += values.tolist()
                order += ranked.tolist()
        return pd.DataFrame({"_row": rows, "pattern_id": ids, "similarity": sims, "_order": order})

    # Tiles that no query has to meet are not compared, nor sent to where they would be.
    needed = asked.select(*tile).distinct()
    if tiles is not None and tiles <= BROADCAST_ROWS:
        needed = F.broadcast(needed)  # else the patterns are shuffled once more for the join alone
    columns = [f.split()[0] for f in _TILED.split(", ")]
    both = asked.select(*columns).unionByName(dealt.join(needed, tile, "left_semi").select(*columns))
    found = both.groupBy(*tile).applyInPandas(
        best, f"_row bigint, pattern_id {id_type}, similarity double, _order double")
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("_order"), "pattern_id"))
    return (found.withColumn("rank", place).filter(F.col("rank") <= k)
            .select("_row", "pattern_id", "similarity", "rank", "_order"))


class _Best:
    """Queries of one length and the best ``k`` patterns that they met so far."""

    def __init__(self, batches: list[tuple], k: int):
        rows, own, least, units = zip(*batches, strict=True)
        self.rows, self.own, self.units = np.concatenate(rows), np.concatenate(own), np.concatenate(units)
        self.least, self.k = np.concatenate(least), k
        self.skip = any(name is not None for name in self.own)
        self.found: list[list[tuple]] = [[] for _ in self.rows]  # (-order, has id, id, similarity)

    def meet(self, names: np.ndarray, units: np.ndarray, able: np.ndarray) -> None:
        """Compare the queries ``able`` with patterns, which are in order of their ids."""
        step = max(1, _CELLS // len(units))
        for lo in range(0, len(able), step):
            some = able[lo:lo + step]
            sims = self.units[some] @ units.T
            near = sims >= (self.least[some] - _SLACK)[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                self._take(int(some[i]), np.flatnonzero(near[i]), sims[i], names)

    def _take(self, row: int, at: np.ndarray, sims: np.ndarray, names: np.ndarray) -> None:
        if self.skip and self.own[row] is not None:
            at = at[names[at] != self.own[row]]
        order = np.round(sims[at], DIGITS) + 0.0  # no -0.0, so that both zeros count as equal
        if len(at) > 4 * self.k:  # equal ones stay, to be told apart by their ids
            high = order >= np.partition(order, len(at) - self.k)[len(at) - self.k]
            at, order = at[high], order[high]
        best = np.argsort(-order, kind="stable")[:self.k]
        new = [(-o, name is not None, name, s) for o, name, s in zip(
            order[best].tolist(), names[at[best]].tolist(), sims[at[best]].tolist(), strict=True)]
        found = sorted([*self.found[row], *new], key=lambda x: x[:3])[:self.k]
        self.found[row] = found
        if len(found) == self.k:
            self.least[row] = max(self.least[row], -found[-1][0])

    def columns(self) -> list[list]:
        flat = [(r, name, sim, -o) for r, found in zip(self.rows.tolist(), self.found, strict=True)
                for o, _, name, sim in found]
        return [list(c) for c in zip(*flat, strict=True)] or [[], [], [], []]


def _units(column: pa.ListArray, size: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal keys."""
    changed = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(keys[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _pieces(centres: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of whole centres, of ``_PIECE_ROWS`` at least but for the last."""
    out, start = [], 0
    for _, hi in _runs(centres):
        if hi - start >= _PIECE_ROWS or hi == len(centres):
            out.append((start, hi))
            start = hi
    return out


def _streamed(cells: DataFrame, clusters: _Clusters, k: int, id_type: str) -> DataFrame:
    """``(_row, pattern_id, similarity, _order)``: the best ``k`` of each part for every query.

    Partitions hold cells one after the other, each with its queries first. These are held;
    the patterns pass by in batches, so that a task never has a part of them at once.
    """
    result = to_arrow_schema(StructType.fromDDL(
        f"_row bigint, pattern_id {id_type}, similarity double, _order double"))

    def task(batches):
        def done():
            for best in held.values():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(best.columns(), result, strict=True)],
                    schema=result)

        cell, asked, held = None, {}, {}
        for batch in batches:
            key, size, query = (batch.column(n).to_numpy(zero_copy_only=False)
                                for n in ("_cell", "_size", "_query"))
            for lo, hi in _runs(key, size, query):
                part, width = batch.slice(lo, hi - lo), int(size[lo])
                if key[lo] != cell:
                    yield from done()
                    cell, asked, held = key[lo], {}, {}
                if query[lo]:
                    least = part.column("_least").fill_null(-2.0).to_numpy()
                    own = np.array([*part.column("_own").to_pylist(), None], object)[:-1]
                    asked.setdefault(width, []).append((
                        part.column("_row").to_numpy(), own, least, _units(part.column("_vec"), width)))
                    continue
                if width in asked:
                    held[width] = _Best(asked.pop(width), k)
                if width in held:
                    compare(held[width], part, width)
        yield from done()

    def compare(best: _Best, part: pa.RecordBatch, width: int) -> None:
        centres = part.column("_centre").to_numpy()
        for lo, hi in _pieces(centres):
            piece = part.slice(lo, hi - lo)
            piece = piece.take(pc.sort_indices(piece.column("_id"), null_placement="at_start"))
            able = clusters.reach(best.units, best.least, np.unique(centres[lo:hi]).tolist())
            if len(able):
                names = piece.column("_id").to_numpy(zero_copy_only=False)
                if piece.column("_id").null_count:  # numbers would become floats
                    names = np.array([*piece.column("_id").to_pylist(), None], object)[:-1]
                best.meet(names, _units(piece.column("_vec"), width), able)

    return cells.mapInArrow(task, f"_row bigint, pattern_id {id_type}, similarity double, _order double")


def _bounded(queries: DataFrame, dealt: DataFrame, clusters: _Clusters, blocks: int, k: int,
             id_type: str) -> DataFrame:
    """``queries`` with ``_least``: the ``k``-th similarity in a small tile near them, if it has so many."""
    unknown = queries.withColumn("_least", F.lit(None).cast("double"))
    if not clusters.centres:
        return unknown
    home = dealt.filter("_part = 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = _compared(_asked(unknown, clusters, blocks, id_type, True), home, k, id_type,
                      (len(clusters.found) + len(clusters.centres)) * blocks)
    bound = first.filter(F.col("rank") == k).select("_row", F.col("_order").alias("_least"))
    return queries.join(bound, "_row", "left")


def _grid(cores: int, queries: int, query_bytes: int, patterns: int) -> tuple[int, int]:
    """Blocks of queries and parts of patterns: about two cells to a core.

    Queries are sent once to each part and patterns to each block, so the numbers do not grow with
    the rows, but where a block would be more than a task is to hold.
    """
    parts = min(math.isqrt(2 * cores) or 1, max(1, patterns // _PART_ROWS))
    blocks = min(-(-2 * cores // parts), max(1, queries // _BLOCK_ROWS))
    return max(blocks, -(-query_bytes // _BLOCK_BYTES)), parts


def _nearest(queries: DataFrame, patterns: DataFrame, id_type: str, k: int, tile_bytes: int) -> DataFrame:
    """The best ``k`` patterns of equal length for every row of ``queries``.

    Both sides are stored tables: ``queries`` with ``_row``, ``_own`` and ``_vec``, ``patterns``
    with ``pattern_id`` and ``pattern``. Where patterns are many, they are ordered by centres, and each
    query first meets a small tile near it, whose ``k``-th similarity is a lower bound. Then blocks of
    queries meet parts of the patterns, centre by centre, and leave out those whose centre and
    radius put them below the bound, which rises as they go. No table passes the driver whole.
    """
    patterns = patterns.filter(F.size("pattern") > 0)
    clusters = _clusters(patterns, tile_bytes)
    clusters.tile_bytes = min(tile_bytes, _HOME_BYTES)
    count, size = queries.agg(F.count("*"), F.sum(F.size("_vec").cast("bigint") * 8 + 64)).first()
    blocks, parts = _grid(queries.sparkSession.sparkContext.defaultParallelism, count, size or 0,
                          sum(n for n, _ in clusters.found.values()))
    dealt = _dealt(patterns, clusters, id_type)
    asked = _bounded(queries, dealt, clusters, blocks, k, id_type).filter(F.size("_vec") > 0)
    columns = ["_cell", "_query", "_size", "_centre", "_row", "_own", "_least", "_id", "_vec"]

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asks = (asked.withColumns({"_query": F.lit(True), "_size": F.size("_vec"), "_centre": F.lit(-1),
                               "_id": F.lit(None).cast(id_type), "_part": every(parts)})
            .withColumn("_cell", F.col("_row") % blocks * parts + F.col("_part")).select(*columns))
    held = (dealt.withColumns({"_least": F.lit(None).cast("double"), "_block": every(blocks)})
            .withColumn("_cell", F.col("_block") * parts + F.pmod(F.xxhash64("_id", "_vec"), F.lit(parts)))
            .select(*columns))
    cells = (asks.unionByName(held).withColumn("_cell", F.col("_cell").cast("int"))
             .repartitionById(blocks * parts, F.col("_cell"))
             .sortWithinPartitions("_cell", F.desc("_query"), "_size", "_centre"))
    found = _streamed(cells, clusters, k, id_type)
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("_order"), "pattern_id"))
    return (found.withColumn("rank", place).filter(F.col("rank") <= k)
            .select("_row", "pattern_id", "similarity", "rank"))


def pattern_bytes(patterns: DataFrame, vector_col: str = "pattern") -> int:
    size = patterns.agg(F.coalesce(
        F.sum(F.size(vector_col).cast("bigint") * 8 + 64), F.lit(0)).alias("b")).first()["b"]
    return int(size)


def knn_topk(queries: DataFrame, patterns: DataFrame, k: int = PATTERN_NEIGHBOURS,
             query_id: str = "query_id", query_vector: str = "vector",
             pattern_id: str = "pattern_id", pattern_vector: str = "pattern",
             exclude_self: bool = False, slice_bytes: int = BROADCAST_BYTES,
             stored: bool = False) -> DataFrame:
    """The ``k`` most similar patterns of equal length for every query, exactly.

    Returns ``query_id, pattern_id, similarity, rank``; equal similarities (to nine
    decimals) go to the smaller pattern id. Every row of ``queries`` is answered for itself,
    also if its id is repeated. Patterns of more than ``slice_bytes`` are ordered by centres; tasks hold
    a block of queries (32 MB) and a batch of patterns at a time, whatever the number of rows.
    ``stored`` says that the patterns are read from a table, and need not be written to one first.
    """
    # Floats are stored and sent as they are, at half the bytes; tasks compute with doubles.
    floats = {_kind(queries, query_vector), _kind(patterns, pattern_vector)} == {"array<float>"}
    kind = "array<float>" if floats else "array<double>"
    table = patterns.select(F.col(pattern_id).alias("pattern_id"),
                            F.col(pattern_vector).cast(kind).alias("pattern"))
    id_type = table.schema["pattern_id"].dataType.simpleString()
    asked = materialize(queries.select(
        F.monotonically_increasing_id().alias("_row"), F.col(query_id).alias("query_id"),
        F.col(query_vector).cast(kind).alias("_vec")), "queries")[0]
    held = table if stored else materialize(table, "patterns")[0]
    own = F.col("query_id").cast(id_type) if exclude_self else F.lit(None).cast(id_type)
    near = _nearest(asked.select("_row", own.alias("_own"), "_vec"), held, id_type, k, slice_bytes)
    return near.join(asked.select("_row", "query_id"), "_row").select(
        "query_id", "pattern_id", "similarity", "rank")


def failure_similarity(queries: DataFrame, patterns: DataFrame,
                       threshold: float = PATTERN_SIMILARITY, query_vector: str = "pattern",
                       slice_bytes: int = BROADCAST_BYTES, stored: bool = False) -> DataFrame:
    """Add ``similarity`` to the nearest failure pattern, ``pattern_id`` and ``is_risk``.

    A query without a pattern of its length has similarity 0 and no risk. Queries
    need no key; tasks hold a block of them and a batch of patterns at a time.
    """
    table = patterns.select("pattern_id",
                            F.col("pattern").cast("array<double>").alias("pattern"))
    id_type = table.schema["pattern_id"].dataType.simpleString()
    asked = materialize(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")[0]
    held = table if stored else materialize(table, "patterns")[0]
    near = _nearest(asked.select("_row", F.lit(None).cast(id_type).alias("_own"),
                                 F.col(query_vector).cast("array<double>").alias("_vec")),
                    held, id_type, 1, slice_bytes)
    found = (asked.drop("pattern_id", "similarity")
             .join(near.select("_row", "pattern_id", "similarity"), "_row", "left").drop("_row"))
    similarity = F.coalesce("similarity", F.lit(0.0))
    return (found.withColumn("similarity", similarity)
            .withColumn("is_risk", F.col("pattern_id").isNotNull()
                        & (F.col("similarity") >= threshold)))
