"""Min-max scaling of feature columns and of model vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AUTOENCODER_SCALE_EPS

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def normalize_features(features: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Scale each numeric column to 0..1 over the whole table; a constant one becomes 0.

    The bounds are a single row, so attaching them costs no shuffle of the features.
    """
    kinds = dict(features.dtypes)
    if columns is None:
        columns = [c for c in features.columns
                   if kinds[c] in _NUMERIC and c != "window_id"]
    bounds = features.agg(*[F.min(c).cast("double").alias(f"_min_{c}") for c in columns],
                          *[F.max(c).cast("double").alias(f"_max_{c}") for c in columns]).first()
    scaled = {}
    for c in columns:
        low, high = bounds[f"_min_{c}"], bounds[f"_max_{c}"]
        if low is None or not high > low:
            scaled[c] = F.lit(0.0)
        else:
            scaled[c] = (F.col(c).cast("double") - F.lit(low)) / F.lit(high - low)
    return features.withColumns(scaled)


def vector_bounds(df: DataFrame, vector_col: str) -> tuple[list[float], list[float], int]:
    """Smallest and largest value of every position of a vector column, and the row count."""
    first = df.select(F.size(vector_col).alias("d")).head()
    if first is None:
        return [], [], 0
    width = first["d"]
    item = [F.get(vector_col, F.lit(i)) for i in range(width)]
    row = df.agg(F.array(*[F.min(x) for x in item]).alias("low"),
                 F.array(*[F.max(x) for x in item]).alias("high"),
                 F.count(F.lit(1)).alias("n")).first()
    return list(row["low"]), list(row["high"]), row["n"]


def ae_scale(vector: Column, low: Sequence[float], high: Sequence[float],
             eps: float = AUTOENCODER_SCALE_EPS) -> Column:
    """Scale by the bounds of the training data. New data may leave 0..1."""
    lows = F.array(*[F.lit(float(x)) for x in low])
    spans = F.array(*[F.lit(float(h) - float(l) + eps) for l, h in zip(low, high)])
    return F.zip_with(F.zip_with(vector, lows, lambda x, l: x - l), spans, lambda x, s: x / s)
