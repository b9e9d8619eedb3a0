"""One interface to both models: fit, score, save, load, and summaries of results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .autoencoder import AutoencoderModel, ae_fit, ae_score
from .isolation_forest import (
    NODE_SCHEMA, IsolationForestModel, iforest_fit, iforest_score,
)

Model = IsolationForestModel | AutoencoderModel
_FIT = {"isolation_forest": iforest_fit, "autoencoder": ae_fit,
        "pytorch_autoencoder": ae_fit}


def fit(kind: str, df: DataFrame, key_cols: Sequence[str], vector_col: str = "features",
        **params) -> Model:
    if kind not in _FIT:
        raise ValueError(f"unsupported model kind: {kind}")
    return _FIT[kind](df, key_cols, vector_col, **params)


def score_batch(df: DataFrame, model: Model, vector_col: str = "features") -> DataFrame:
    """Add ``anomaly_score``, ``is_anomaly`` and ``model_type`` to every row."""
    score = iforest_score if model.kind == "isolation_forest" else ae_score
    return score(df, model, vector_col).withColumn("model_type", F.lit(model.kind))


def model_save(spark: SparkSession, model: Model, path: str) -> None:
    """Write the parameters as Parquet, then one JSON row of metadata that completes it.

    Parameters go to a folder of their own, which the metadata names: whoever reads while, or
    after, a save was broken off finds the old model, the new one, or none, but no mixture.
    """
    parameters = f"parameters-{uuid.uuid4().hex}"
    if model.kind == "isolation_forest":
        table = spark.createDataFrame(model.nodes, NODE_SCHEMA)
        meta = {"sample_size": model.sample_size, "offset": model.offset,
                "width": model.width}
    else:
        table = spark.createDataFrame(
            pd.DataFrame({"position": np.arange(len(model.weights)), "weight": model.weights}),
            "position int, weight double")
        meta = {"sizes": list(model.sizes), "activation": model.activation,
                "low": list(model.low), "high": list(model.high),
                "threshold": model.threshold, "losses": model.losses}
    meta |= {"kind": model.kind, "params": model.params, "parameters": parameters}
    table.coalesce(1).write.parquet(f"{path}/{parameters}")
    (spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path}/metadata"))


def saved_parameters(spark: SparkSession, path: str) -> DataFrame:
    """The parameters of a saved model as a table."""
    return spark.read.parquet(f"{path}/{_metadata(spark, path)['parameters']}")


def _metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def model_load(spark: SparkSession, path: str) -> Model:
    """Restore a saved model of either kind; ``FileNotFoundError`` if there is none."""
    try:
        meta = _metadata(spark, path)
        table = spark.read.parquet(f"{path}/{meta['parameters']}")
    except (AnalysisException, TypeError) as error:
        raise FileNotFoundError(f"no model at {path}") from error
    if meta["kind"] == "isolation_forest":
        nodes = table.toPandas().sort_values(["tree", "node"], ignore_index=True)
        return IsolationForestModel(nodes, meta["sample_size"], meta["offset"], meta["params"],
                                    meta["width"])
    weights = table.orderBy("position").toPandas()["weight"].to_numpy()
    return AutoencoderModel(meta["sizes"], meta["activation"], weights, meta["low"],
                            meta["high"], meta["threshold"], meta["losses"], meta["params"])


def anomaly_summary(results: DataFrame) -> DataFrame:
    """Count, total, percentage of anomalies and whether there are any; zeros when empty."""
    found = F.count_if("is_anomaly")
    total = F.count(F.lit(1))
    return results.agg(
        found.alias("count"), total.alias("total"),
        F.coalesce(F.try_divide(found, total) * 100, F.lit(0.0)).alias("percentage"),
        (found > 0).alias("has_anomaly"))


def anomaly_recent(results: DataFrame, time: str = "timestamp") -> DataFrame:
    """Score and flag of the latest row, and the mean score."""
    order = [F.col(time)] + [F.col(c) for c in ("source",) if c in results.columns]
    last = F.max_by(F.struct("anomaly_score", "is_anomaly"), F.struct(*order))
    return results.agg(last.alias("l"), F.avg("anomaly_score").alias("a")).select(
        F.coalesce("l.anomaly_score", F.lit(0.0)).alias("score"),
        F.coalesce("l.is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("a", F.lit(0.0)).alias("avg_score"))
