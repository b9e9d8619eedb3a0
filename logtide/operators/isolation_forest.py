"""Isolation Forest (Liu, Ting, Zhou 2008): sampled, built and scored as Spark jobs.

Each tree sees at most ``max_samples`` rows, drawn by hashing the row key, so the sample
is the same however the data is partitioned. Trees are built a few per group and come back
as a node table whose size depends on the number of trees only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FOREST_CONTAMINATION, FOREST_SUBSAMPLE, FOREST_TREES, MODEL_SEED
from ..session import scratch_table
from ..functions.vectors import of_width
from .quantiles import DIRECT_ROWS, exact_quantile

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "path_length double, size int")
_HASH_RANGE = 1 << 40
# Rows drawn per tree before the exact cut to ``max_samples``.
_OVERSAMPLE = 2
# Trees whose samples meet in one task.
_TREES_TOGETHER = 10


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    sample_size: int
    offset: float
    params: dict = field(default_factory=dict)
    width: int | None = None
    kind: str = "isolation_forest"


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(
        n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


def _drawn(df: DataFrame, key_cols: Sequence[str], n: int, n_trees: int, sample_size: int,
           seed: int) -> DataFrame:
    """Rows that may be in the sample of a tree: a few more than it needs, once for each ``tree``.

    Every tree draws for itself, whatever the number of rows, by the hash of the keys. Rows are
    dealt to trees and filtered within one generated stage, so little is shuffled.
    """
    wanted = _OVERSAMPLE * sample_size
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    draw = F.pmod(F.xxhash64(*key_cols, F.lit(seed), F.col("tree")), F.lit(_HASH_RANGE))
    drawn = df.withColumn("tree", trees).withColumn("_draw", draw)
    if n > wanted:
        drawn = drawn.filter(F.col("_draw") < _HASH_RANGE * wanted // n)
    return drawn.withColumn("_group", F.expr(f"tree div {_TREES_TOGETHER}"))


def _cut(group: pd.DataFrame, key_cols: Sequence[str], sample_size: int) -> pd.DataFrame:
    """The exact samples of the trees of a group, with the ``rank`` of each row."""
    ordered = group.sort_values(["tree", "_draw", *key_cols], ignore_index=True)
    ordered["rank"] = ordered.groupby("tree").cumcount() + 1
    return ordered[ordered["rank"] <= sample_size]


def tree_samples(df: DataFrame, key_cols: Sequence[str], n: int, n_trees: int,
                 sample_size: int, seed: int) -> DataFrame:
    """``(tree, rank, ...)``: ``sample_size`` rows of ``df`` for each tree."""
    drawn = _drawn(df, key_cols, n, n_trees, sample_size, seed)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    names = ["tree", "rank", *df.columns]
    return drawn.groupBy("_group").applyInPandas(
        lambda group: _cut(group, key_cols, sample_size)[names],
        f"tree int, rank int, {columns}")


def grow_tree(rows: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes ``(node, feature, threshold, left, right, path_length, size)``.

    Leaves have feature -1 and the number of their rows as size; it is 0 for the others.
    """
    nodes, pending = [], [(0, np.arange(len(rows)), 0)]
    next_node = 1
    while pending:
        node, members, depth = pending.pop()
        part = rows[members]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= max_depth or len(members) <= 1 or not len(splittable):
            nodes.append((node, -1, 0.0, node, node, depth + float(average_path(len(members))),
                          len(members)))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # rounded up between neighbouring values: one side would be empty
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        left, right = next_node, next_node + 1
        next_node += 2
        nodes.append((node, feature, threshold, left, right, 0.0, 0))
        pending.append((left, members[goes_left], depth + 1))
        pending.append((right, members[~goes_left], depth + 1))
    return nodes


def iforest_fit(df: DataFrame, key_cols: Sequence[str], vector_col: str = "features",
                n_estimators: int = FOREST_TREES, contamination: float = FOREST_CONTAMINATION,
                seed: int = MODEL_SEED, max_samples: int = FOREST_SUBSAMPLE,
                stored: bool = False) -> IsolationForestModel:
    """Fit on a vector column. ``key_cols`` must identify a row.

    The input is read several times, so it is written to shared storage first, unless
    ``stored`` says that it already is a table.
    """
    with scratch_table(df.select(*key_cols, vector_col), "forest-input", stored) as rows:
        rows = rows.select(*key_cols, vector_col)
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
        if n == 0:
            raise ValueError("no rows to train on")
        sample_size = min(max_samples, n)
        max_depth = int(np.ceil(np.log2(max(sample_size, 2))))
        columns = [part.split()[0] for part in NODE_SCHEMA.split(", ")]

        def build(group: pd.DataFrame) -> pd.DataFrame:
            nodes = []
            for tree, sample in _cut(group, key_cols, sample_size).groupby("tree"):
                grown = grow_tree(np.stack(sample[vector_col].to_list()).astype(float),
                                  np.random.default_rng([seed, int(tree)]), max_depth)
                nodes += [(int(tree), *node) for node in grown]
            return pd.DataFrame(nodes, columns=columns)

        drawn = _drawn(rows, key_cols, n, n_estimators, sample_size, seed)
        nodes = (drawn.groupBy("_group").applyInPandas(build, NODE_SCHEMA).toPandas()
                 .sort_values(["tree", "node"], ignore_index=True))
        model = IsolationForestModel(nodes, sample_size, 0.0, {
            "n_estimators": n_estimators, "contamination": contamination, "seed": seed,
            "max_samples": max_samples}, width)
        scores = rows.select(_raw_score(rows, model, vector_col).alias("s"))
        if n <= DIRECT_ROWS:  # one pass, so nothing need be kept
            model.offset = exact_quantile(scores, "s", contamination, at_most=n)
        else:
            with scratch_table(scores, "forest-scores") as held:
                model.offset = forest_threshold(held, "s", contamination)
    return model


def forest_threshold(scores: DataFrame, score_col: str,
                     contamination: float = FOREST_CONTAMINATION) -> float:
    """Score below which the given share of the rows lies."""
    return exact_quantile(scores, score_col, contamination)


def _raw_score(df: DataFrame, model: IsolationForestModel, vector_col: str) -> Column:
    """``-2 ** (-E[path] / c)`` of each row: closer to -1 is more anomalous."""
    nodes = model.nodes.sort_values(["tree", "node"], ignore_index=True)
    start = nodes.index[nodes["node"] == 0].to_numpy()
    # The nodes of a tree are numbered without gaps, so a node's row is start + number.
    base = np.repeat(start, np.diff(np.append(start, len(nodes))))
    arrays = (nodes["feature"].to_numpy(np.int32), nodes["threshold"].to_numpy(float),
              (base + nodes["left"]).to_numpy(np.int32), (base + nodes["right"]).to_numpy(np.int32),
              nodes["path_length"].to_numpy(float), start.astype(np.int32))
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    norm = float(average_path(model.sample_size)) or 1.0
    depth = int(np.ceil(np.log2(max(model.sample_size, 2))))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        feature, threshold, left, right, path, roots = shared.value
        out = np.empty(len(vectors))
        for lo in range(0, len(vectors), 4096):
            x = np.stack(vectors.iloc[lo:lo + 4096].to_list()).astype(float)
            at = np.broadcast_to(roots, (len(x), len(roots)))
            row = np.arange(len(x))[:, None]
            for _ in range(depth):
                f = feature[at]
                small = x[row, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(small, left[at], right[at]))
            out[lo:lo + 4096] = -np.exp2(-path[at].mean(axis=1) / norm)
        return pd.Series(out)

    return score(of_width(F.col(vector_col), model.width))


def iforest_score(df: DataFrame, model: IsolationForestModel, vector_col: str = "features"
                  ) -> DataFrame:
    """Add ``anomaly_score`` (lower is worse) and ``is_anomaly`` (below zero)."""
    return (df.withColumn("anomaly_score",
                          _raw_score(df, model, vector_col) - F.lit(model.offset))
            .withColumn("is_anomaly", F.col("anomaly_score") < 0))
