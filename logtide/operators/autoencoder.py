"""Dense autoencoder trained by parameter averaging, scored by reconstruction error.

The rows are dealt into shards by the hash of their key. Every epoch is one Spark job: each
shard runs mini-batch Adam from the current weights over its rows, in key order, and returns
its weights; they are averaged by row count, in the order of the shards. The number of shards
follows from the number of rows alone, so the model is the same on any cluster; up to
``SHARD_ROWS`` rows this is plain sequential training.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..constants import (
    AUTOENCODER_CODE, AUTOENCODER_HIDDEN, AUTOENCODER_THRESHOLD_QUANTILE, MODEL_SEED,
)
from ..functions.vectors import of_width
from ..session import scratch_table
from .quantiles import exact_quantile
from .scaling import ae_scale, vector_bounds

_BETA1, _BETA2, _ADAM_EPS = 0.9, 0.999, 1e-8
#: Rows of a shard, in the mean; recorded in the model.
SHARD_ROWS = 8192
# Shards whose weights are averaged in one task.
_AVERAGED = 64
_WORKER_SCHEMA = ("shard bigint, rows bigint, steps bigint, loss array<double>, "
                  "weights array<double>, m array<double>, v array<double>")


@dataclass
class AutoencoderModel:
    sizes: list[int]
    activation: str
    weights: np.ndarray
    low: list[float]
    high: list[float]
    threshold: float = 0.0
    losses: list[float] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    kind: str = "autoencoder"


def layer_sizes(width: int, hidden: Sequence[int], code: int) -> list[int]:
    return [width, *hidden, code, *reversed(hidden), width]


def initial_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """All layers in one vector, uniform within 1/sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    parts = []
    for n_in, n_out in zip(sizes, sizes[1:]):
        bound = 1 / np.sqrt(n_in)
        parts.append(rng.uniform(-bound, bound, n_in * n_out + n_out))
    return np.concatenate(parts)


def _layers(weights: np.ndarray, sizes: Sequence[int]):
    at = 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        matrix = weights[at:at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        yield matrix, weights[at:at + n_out]
        at += n_out


def reconstruct(weights: np.ndarray, sizes: Sequence[int], activation: str,
                x: np.ndarray) -> list[np.ndarray]:
    """Output of every layer, the input first and the reconstruction last."""
    outputs = [x]
    for i, (matrix, bias) in enumerate(_layers(weights, sizes)):
        z = outputs[-1] @ matrix + bias
        if i == len(sizes) - 2:
            outputs.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        else:
            outputs.append(np.tanh(z) if activation == "tanh" else np.maximum(z, 0))
    return outputs


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], activation: str,
                      x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared error over all elements of the batch and its gradient."""
    outputs = reconstruct(weights, sizes, activation, x)
    error = outputs[-1] - x
    delta = 2 * error / error.size * outputs[-1] * (1 - outputs[-1])
    parts = []
    layers = list(_layers(weights, sizes))
    for i in range(len(layers) - 1, -1, -1):
        parts.append(delta.sum(axis=0))
        parts.append((outputs[i].T @ delta).ravel())
        if i:
            slope = 1 - outputs[i] ** 2 if activation == "tanh" else outputs[i] > 0
            delta = (delta @ layers[i][0].T) * slope
    return float(np.mean(error ** 2)), np.concatenate(parts[::-1])


def ae_fit(df: DataFrame, key_cols: Sequence[str], vector_col: str = "features",
           hidden: Sequence[int] = AUTOENCODER_HIDDEN, code: int = AUTOENCODER_CODE,
           activation: str = "relu", epochs: int = 50, batch_size: int = 32,
           learning_rate: float = 1e-3, seed: int = MODEL_SEED,
           shard_rows: int = SHARD_ROWS, stored: bool = False) -> AutoencoderModel:
    """Fit on a vector column of normal data; ``key_cols`` identify a row.

    The input is written to shared storage first, unless ``stored`` says it is a table.
    """
    with scratch_table(df.select(*key_cols, vector_col), "autoencoder-input", stored) as rows:
        low, high, n = vector_bounds(rows, vector_col)
        if n == 0:
            raise ValueError("no rows to train on")
        sizes = layer_sizes(len(low), hidden, code)
        shards = -(-n // shard_rows)
        shard = F.pmod(F.xxhash64(*key_cols), F.lit(shards)).alias("shard")
        scaled = rows.select(*key_cols, shard, ae_scale(F.col(vector_col), low, high).alias("x"))
        weights = initial_weights(sizes, seed)
        m, v, steps = np.zeros_like(weights), np.zeros_like(weights), 0
        losses = []

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(group.sort_values(list(key_cols))["x"].to_list()).astype(float)
            return pd.DataFrame({"shard": [group["shard"].iloc[0]], "x": [x.tobytes()]})

        # One row per shard, so that an epoch neither sorts nor groups.
        packed = scaled.groupBy("shard").applyInPandas(pack, "shard bigint, x binary")
        with scratch_table(packed, "autoencoder-shards") as parts:
            parts = parts.repartition(shards) if shards > 1 else parts
            # A single shard needs no averaging between epochs, so one job runs them all. Shards
            # that are not full go over their rows as often as makes about as many steps.
            passes = max(1, round(shards * shard_rows / n)) if shards > 1 else epochs
            for _ in range(epochs if shards > 1 else 1):
                result = _epoch(parts, (weights, m, v, steps), sizes, activation, batch_size,
                                learning_rate, shards, passes)
                weights, m, v = (np.array(result[name]) for name in ("weights", "m", "v"))
                steps = result["steps"]
                losses += result["loss"][-1:] if shards > 1 else result["loss"]
        model = AutoencoderModel(sizes, activation, weights, low, high, losses=losses, params={
            "epochs": epochs, "batch_size": batch_size, "learning_rate": learning_rate,
            "seed": seed, "shard_rows": shard_rows})
        with scratch_table(ae_errors(rows, model, vector_col).select("anomaly_score"),
                           "autoencoder-errors") as errors:
            model.threshold = ae_threshold(errors, "anomaly_score")
    return model


def _epoch(parts: DataFrame, state, sizes, activation, batch_size, rate, shards, rounds):
    """One row: the averaged result of all shards."""
    shared = parts.sparkSession.sparkContext.broadcast(state)

    def train(shard: int, packed: bytes) -> pd.DataFrame:
        weights, m, v, steps = shared.value
        weights, m, v = weights.copy(), m.copy(), v.copy()
        losses, x = [0.0] * rounds, np.frombuffer(packed).reshape(-1, sizes[0])
        for i in range(rounds):
            for lo in range(0, len(x), batch_size):
                batch = x[lo:lo + batch_size]
                loss, gradient = loss_and_gradient(weights, sizes, activation, batch)
                steps += 1
                m = _BETA1 * m + (1 - _BETA1) * gradient
                v = _BETA2 * v + (1 - _BETA2) * gradient ** 2
                weights -= rate * (m / (1 - _BETA1 ** steps)) / (
                    np.sqrt(v / (1 - _BETA2 ** steps)) + _ADAM_EPS)
                losses[i] += loss * len(batch) / len(x)
        return pd.DataFrame({"shard": [shard], "rows": [len(x)], "steps": [steps],
                             "loss": [losses], "weights": [weights], "m": [m],
                             "v": [v]})

    def work(frames):
        for frame in frames:
            for shard, packed in zip(frame["shard"], frame["x"]):
                yield train(shard, packed)

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        share = group["rows"].to_numpy(float) / group["rows"].sum()
        mean = {name: [sum(w * np.asarray(x) for w, x in zip(share, group[name]))]
                for name in ("weights", "m", "v", "loss")}
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "rows": [group["rows"].sum()],
                             "steps": [group["steps"].max()], **mean})

    results = parts.mapInPandas(work, _WORKER_SCHEMA)
    while shards > 1:
        # Averages of averages, so that no task and not the driver holds all weights.
        results = (results.withColumn("shard", F.expr(f"shard div {_AVERAGED}"))
                   .groupBy("shard").applyInPandas(average, _WORKER_SCHEMA))
        shards = -(-shards // _AVERAGED)
    result = results.first()
    shared.unpersist()
    return result


def ae_threshold(errors: DataFrame, error_col: str,
                 q: float = AUTOENCODER_THRESHOLD_QUANTILE) -> float:
    """Quantile of the training errors above which a row is an anomaly."""
    return exact_quantile(errors, error_col, q)


def ae_errors(df: DataFrame, model: AutoencoderModel, vector_col: str = "features") -> DataFrame:
    """Add ``anomaly_score``: the mean squared reconstruction error of the scaled vector."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    sizes, activation = list(model.sizes), model.activation

    @F.pandas_udf("double")
    def error(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        x = np.stack(vectors.to_list())
        return pd.Series(np.mean((x - reconstruct(shared.value, sizes, activation, x)[-1]) ** 2,
                                 axis=1))

    vector = of_width(F.col(vector_col), len(model.low))
    return df.withColumn("anomaly_score", error(ae_scale(vector, model.low, model.high)))


def ae_score(df: DataFrame, model: AutoencoderModel, vector_col: str = "features") -> DataFrame:
    """Add ``anomaly_score`` (higher is worse) and ``is_anomaly`` (above the threshold)."""
    return ae_errors(df, model, vector_col).withColumn(
        "is_anomaly", F.col("anomaly_score") > F.lit(model.threshold))
