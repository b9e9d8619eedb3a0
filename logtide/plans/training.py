"""Training from stored logs or files, and detection on new logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..constants import MIN_TRAINING_WINDOWS, TRAINING_DAYS, WINDOW_SECONDS
from ..operators.models import Model, fit, model_save, score_batch
from ..operators.similarity import with_vector
from ..operators.windows import window_features
from ..session import scratch_table
from ..sources.tables import scan_recent_days

KEYS: Sequence[str] = ("source", "window_id")


def train(logs: DataFrame, kind: str = "isolation_forest",
          window_seconds: int = WINDOW_SECONDS, **params) -> Model | None:
    """Fit a model on the windows of the given logs; ``None`` if there are too few.

    The features are written once; every pass of the fit reads that small table.
    """
    features = with_vector(window_features(logs, window_seconds))
    with scratch_table(features.select(*KEYS, "features"), "training") as rows:
        least = MIN_TRAINING_WINDOWS if kind != "isolation_forest" else 1
        if rows.limit(least).count() < least:
            return None
        return fit(kind, rows, KEYS, stored=True, **params)


def retrain(logs: DataFrame, as_of, path: str, kind: str = "isolation_forest",
            days_back: int = TRAINING_DAYS, limit: int | None = None, **params) -> bool:
    """Fit on the days up to ``as_of`` and save. False, and nothing saved, without data."""
    model = train(scan_recent_days(logs, as_of, days_back, limit), kind, **params)
    if model is None:
        return False
    model_save(logs.sparkSession, model, path)
    return True


def detect(logs: DataFrame, model: Model, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Windows of the given logs with their scores."""
    return score_batch(with_vector(window_features(logs, window_seconds)), model)


def join_scores(results: DataFrame, features: DataFrame) -> DataFrame:
    """Results with the features of their window, by source and window start."""
    right = features.withColumnRenamed("timestamp", "window_start")
    return results.join(right, ["source", "window_start"])
