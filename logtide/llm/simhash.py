"""SimHash fingerprints and the groups that near fingerprints form.

Links are found by anchor points. Either half of a fingerprint is a point of the 32-bit
space, in which the words of the Hamming code [31, 26], with one free bit beside it, are the
anchors: every point has an anchor within ``RADIUS`` 1. Two fingerprints with at most three
differing bits have at most one of them in one half (the threshold of that half), so in
that half the one lies within ``RADIUS`` of its own anchor and the other within ``RADIUS`` +
1 of the same anchor. Each fingerprint is therefore copied to the (at most 17) anchors within
that distance in each half, and every anchor compares the fingerprints that have it as their
own anchor with all that were copied to it.

Most anchors get one copy, and those that get a few by chance grow with the square of the
table. So copies are sorted by anchor and a task compares all anchors of a batch at once;
nothing is counted or joined before, and no anchor costs a call of its own unless it has many.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logtide.llm.common import arrow_pass, counted, releasing, stored, utf8
from logtide.llm.components import connected_components

#: Fixed values of the fingerprint: words to a shingle, seed of the hash, bits that may differ.
SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3

# Fingerprints of one anchor that a task compares with others at a time.
_TILE = 2048
# Fingerprints of one anchor up to which all pairs are made, and rows that a task takes at a time.
_FEW = 64
_ROWS = 1 << 14
_HASHES = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, unsigned; zero without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    shingles = zip(*(words[i:] for i in range(width)), strict=False)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), HASH_SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _HASHES):
        part = hashes[lo:lo + _HASHES].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; ``fp`` holds the 64 bits as a signed long."""
    def task(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, fp long")


def _anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within ``RADIUS`` + 1 of both halves of ``fps``: anchor, row, own anchor or not."""
    rows = np.arange(len(fps))
    anchors, owners, own = [], [], []

    def add(points, which, is_own):
        anchors.append(points)
        owners.append(rows[which])
        own.append(np.full(len(points), is_own))

    everything = np.ones(len(fps), bool)
    for half in (0, 1):
        point = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word = point & 0x7FFFFFFF
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(1, 32):
            syndrome ^= i * ((word >> (i - 1)) & 1)
        off = syndrome > 0
        nearest = np.where(off, point ^ (1 << np.maximum(syndrome - 1, 0)), point)
        base = half << 32
        add(base | nearest, everything, True)
        add(base | (nearest ^ (1 << 31)), everything, False)
        for i in range(1, 32):
            other = i ^ syndrome
            pair = off & (i < other)
            flipped = point[pair] ^ (1 << (i - 1)) ^ (1 << (other[pair] - 1))
            add(base | flipped, pair, False)
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(own)


def _replicas(fps: DataFrame) -> DataFrame:
    """``(key, fp)`` for all anchors of ``fps``: the key is twice the anchor, and one more where the
    anchor is not the fingerprint's own, so that own ones come first."""
    def task(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            anchor, row, own = _anchors(values.view(np.uint64))
            yield {"key": pa.array(anchor << 1 | ~own), "fp": pa.array(values[row])}

    return arrow_pass(fps.select("fp"), task, "key long, fp long")


def _span(own: np.ndarray, copies: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is near within a tile: a forest, never all pairs."""
    label = {fp: i for i, fp in enumerate(copies)}
    labels = np.arange(len(copies))
    found = []
    for fp in own:
        near = np.flatnonzero(np.bitwise_count(copies ^ fp) <= MAX_BITS)
        if not len(near):
            continue
        parts = np.unique(labels[near])
        here = label.get(fp)
        if here is None:  # it stands in another tile; one link to each part ties them
            found += [(fp, copies[np.flatnonzero(labels == p)[0]]) for p in parts]
        else:
            found += [(fp, copies[p]) for p in parts if p != labels[here]]
            parts = np.unique(np.append(parts, labels[here]))
        labels[np.isin(labels, parts)] = parts[0]
    return found


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of ``n`` nodes that links ``a`` to ``b`` tie each node to."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _links(fps: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Links within groups of ``size`` rows, own ones first: a forest for each group."""
    start = np.cumsum(size) - size
    few = size <= _FEW
    left = np.flatnonzero(own & np.repeat(few, size))
    first, n = np.repeat(start, size)[left], np.repeat(size, size)[left]
    a = np.repeat(left, n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS)
    root = _roots(len(fps), a[near], b[near])
    tied = np.flatnonzero(root != np.arange(len(fps)))
    found = [np.stack([fps[tied], fps[root[tied]]], axis=1)]
    for lo, n in zip(start[~few], size[~few], strict=True):
        rows = fps[lo:lo + n]
        found.append(np.array(_span(rows[own[lo:lo + n]], rows), np.uint64).reshape(-1, 2))
    return np.concatenate(found)


def _compared(tile: int):
    """A pass over rows of ``_replicas`` sorted by key: the links of every anchor.

    Rows of an anchor with more than ``tile`` of them, and its own among them, are numbered by
    tiles and handed on as they come.
    """
    def task(batches):
        held = [np.empty(0, np.int64)] * 2  # rows of the anchor whose end has not come yet
        crowd, passed = -1, 0  # the last crowded anchor and how many of its rows were handed on
        for batch in chain((x.slice(lo, _ROWS) for x in batches
                            for lo in range(0, x.num_rows, _ROWS)), [None]):
            key, fp = held if batch is None else [
                np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(key):
                continue
            anchor, own = key >> 1, key & 1 == 0
            start = np.flatnonzero(np.diff(anchor, prepend=-1))
            size = np.diff(start, append=len(key))
            before = np.where(anchor[start] == crowd, passed, 0)
            wanted = own[start] | (before > 0)
            crowded = wanted & (size + before > tile)
            if crowded.any():
                rows = np.repeat(crowded, size)
                place = (np.arange(len(key)) - np.repeat(start - before, size))[rows]
                yield {"a": fp[rows], "b": pa.nulls(len(place), pa.int64()), "anchor": anchor[rows],
                       "tile": place // tile, "own": own[rows]}
            if crowded[-1]:
                crowd, passed = anchor[-1], size[-1] + before[-1]
            open_ = np.zeros(len(start), bool)
            open_[-1] = batch is not None
            ready = wanted & ~crowded & ~open_ & (size > 1)
            rows = np.repeat(ready, size)
            found = _links(fp[rows].view(np.uint64), own[rows], size[ready]).view(np.int64)
            if len(found):
                nothing = pa.nulls(len(found), pa.int64())
                yield {"a": found[:, 0], "b": found[:, 1], "anchor": nothing, "tile": nothing,
                       "own": pa.nulls(len(found), pa.bool_())}
            rows = np.repeat(wanted & ~crowded & open_, size)
            held = [key[rows], fp[rows]]

    return task


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that join all within ``MAX_BITS``.

    Copies are dealt and sorted by anchor. An anchor with many fingerprints is cut into tiles of
    ``_TILE`` by ``_TILE``, each compared in a task of its own. An anchor or a tile returns
    only the links that join its parts. No row count is left to Spark's estimates, which do not
    know how many copies there are: only crowded anchors, read from a table, are joined.
    """
    dealt = _replicas(fps).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    found = stored(arrow_pass(dealt, _compared(_TILE), "a long, b long, anchor long, tile long, "
                                                       "own boolean"), "near")
    links, crowded = found.where("anchor is null").select("a", "b"), found.where("anchor is not null")
    if crowded.isEmpty():
        return links
    tiles = crowded.groupBy("anchor").agg(F.max("tile").alias("tiles"),
                                          F.max(F.when(F.col("own"), F.col("tile"))).alias("lefts"))
    crowded = crowded.withColumnRenamed("a", "fp").join(tiles, "anchor")
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    rows = (crowded.where("own")
            .select("anchor", F.col("tile").alias("i"), upto(F.col("tiles")).alias("j"), "fp",
                    F.lit(True).alias("left"))
            .union(crowded.select("anchor", upto(F.col("lefts")).alias("i"),
                                  F.col("tile").alias("j"), "fp", F.lit(False))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fps, left = group["fp"].to_numpy().view(np.uint64), group["left"].to_numpy(bool)
        found = np.array(_span(np.sort(fps[left]), np.sort(fps[~left])), np.uint64).reshape(-1, 2)
        return pd.DataFrame({"a": found[:, 0].view(np.int64) if len(found) else [],
                             "b": found[:, 1].view(np.int64) if len(found) else []},
                            dtype="int64")

    return links.union(stored(rows.groupBy("anchor", "i", "j")
                              .applyInPandas(compare, "a long, b long"), "crowded"))


def _grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, group, component_id)`` for every row; ``group`` is one fingerprint of it."""
    by_doc = stored(fingerprints(docs), "fingerprints")
    points = stored(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    parts = connected_components(near_links(points)).withColumnRenamed("node", "fp")
    linked = stored(points.join(parts, "fp"), "linked")
    rows = linked.count()
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = counted(linked, rows).join(lowest, "component").select("fp", "component", "lowest")
    named = points.join(counted(linked, rows), "fp", "left")
    named = named.select("fp", F.coalesce("component", "fp").alias("group"),
                         F.coalesce("lowest", "first").alias("component_id"))
    return (counted(by_doc, by_doc.count()).join(named, "fp")
            .select("doc_id", "fp", "group", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    A null text counts as empty and has fingerprint zero, which links like any other. Texts of
    one or two words make one shingle. Equal fingerprints are one point of the comparison, so
    exact copies cost nothing. A repeated row is returned again with the same component; a row
    with a null ``doc_id`` is returned, but cannot name a component (null if all are null).
    Only ``doc_id`` and ``text`` are read; no rows give no rows.
    """
    return _grouped(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group, the one with the smallest id.

    Rows are judged one by one: where an id is repeated, each of its rows goes or stays with the
    group of its own text, and of several rows that could stand for a group the one with
    the smallest fingerprint and text does, so that a repeated row stays once. Rows with a null
    id stay, since nothing names them. A null or empty text is one group with all others
    like it. Columns stay as they are, whatever their names; no rows give no rows.
    """
    groups = stored(_grouped(docs), "groups").where("doc_id is not null")
    id_type = docs.schema["doc_id"].dataType
    later = groups.where("doc_id <> component_id").select(F.col("doc_id").cast(id_type))
    later = counted(later, later.count())
    repeated = stored(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
                      .select(F.col("doc_id").cast(id_type)), "repeated")
    twice = repeated.count()
    if not twice:
        return docs.join(later, "doc_id", "left_anti").select(docs.columns)
    repeated = counted(repeated, twice)
    once = (docs.join(later, "doc_id", "left_anti").join(repeated, "doc_id", "left_anti")
            .select(docs.columns))
    names = {c.lower() for c in docs.columns}
    row, fp = (next(n for i in range(len(names) + 1) if (n := f"{stem}{i}").lower() not in names)
               for stem in ("row", "fp"))
    again = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    again = _with_fingerprint(again.select(F.struct(*again.columns).alias(row), "doc_id", "text"),
                              row, fp)
    firsts = (groups.where("doc_id = component_id").join(repeated.withColumn(
        "doc_id", F.col("doc_id").cast("long")), "doc_id", "left_semi")
              .select("doc_id", F.col("fp").alias(fp), "group").distinct())
    again = (again.join(counted(firsts, firsts.count()), ["doc_id", fp])
             .groupBy("group").agg(F.min_by(row, F.struct(fp, "text")).alias(row))
             .select(f"{row}.*"))
    return once.unionByName(again.select(docs.columns))


def _with_fingerprint(rows: DataFrame, row: str, fp: str) -> DataFrame:
    """``(row, doc_id, text, fp)`` for a table of ``(row, doc_id, text)``."""
    schema = StructType([*rows.schema.fields, StructField(fp, LongType())])

    def task(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield batch.append_column(fp, pa.array(fps.view(np.int64)))

    return rows.mapInArrow(releasing(task), schema).withColumn("doc_id", F.col("doc_id").cast("long"))
